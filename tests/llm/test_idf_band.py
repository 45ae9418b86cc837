"""The idf band of I-Match holds terms, however many there are."""

from __future__ import annotations

from gaugework.llm import imatch


def test_band_of_many_terms(spark):
    """More terms than hash classes: rare terms stay outside, terms of the band inside."""
    shared = [[f"s{g}x{j}" for j in range(12)] for g in range(50)]
    texts = [" ".join(["all", *shared[i // 2], *[f"u{i}x{j}" for j in range(2000)]]) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs).collect()}
    assert {p.split(" ")[0] for p in prints.values()} == {"12"}
    assert all(prints[2 * g] == prints[2 * g + 1] for g in range(50))
    # The edited text: its own shared terms, those of the next document's first third, and no rare ones.
    sizes = {int(r["edited_fingerprint"].split(" ")[0]) for r in imatch.edit_likeness(docs).collect()}
    assert sizes == {12, 24}
