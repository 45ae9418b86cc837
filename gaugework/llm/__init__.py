"""Training-data operators: deduplication, scanning, scoring, mixing and tokenizing of text tables."""
