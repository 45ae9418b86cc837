"""The encoder's character tables and its streaming, against the library."""

from __future__ import annotations

import hashlib
import random
import sys
import unicodedata
from pathlib import Path

import pytest

sys.path.insert(0, "/opt/tokenizers")
pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from gaugework.llm import bpe, queries  # noqa: E402


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    return Tokenizer.from_file(path), bpe.Encoder(Path(path).read_text())


def ids(lib, text: str) -> list[int]:
    return lib.encode(text, add_special_tokens=False).ids


def test_code_points_are_classed_as_the_library_does(both):
    lib, enc = both
    # All of the first planes but ideographs and syllables, of which, as of the rest, every 97th and the blocks' ends.
    dense = [*range(0, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x14700), *range(0x16800, 0x20000)]
    sparse = [*range(0, 0x110000, 97), *range(0x2A6D0, 0x2A710), *range(0x2B730, 0x2B830), *range(0x2CE90, 0x2CEC0), *range(0x323A0, 0x323C0), *range(0x33470, 0x33480)]
    points = sorted({c for c in (*dense, *sparse) if not 0xD800 <= c < 0xE000})
    for i in range(0, len(points), 2048):
        for form in ("a{}1", "e{}̖́x"):
            text = " ".join(form.format(chr(c)) for c in points[i : i + 2048])
            assert enc.encode(text) == ids(lib, text), hex(points[i])


def test_normal_forms_are_the_library_s(both):
    lib, enc = both
    pairs = [unicodedata.decomposition(chr(c)) for c in range(0x30000)]
    for pair in pairs:
        if " " in pair and "<" not in pair:
            text = "x " + "".join(chr(int(p, 16)) for p in pair.split()) + "q"
            assert enc.encode(text) == ids(lib, text), pair
    rng = random.Random(5)
    marks = [chr(c) for c in range(0x20000) if unicodedata.combining(chr(c))]
    for _ in range(4000):
        text = "".join(rng.choice(marks) if rng.random() < 0.6 else rng.choice("aeoAÉÜ가かк") for _ in range(rng.randint(2, 9)))
        assert enc.encode(text) == ids(lib, text), text


def test_long_texts_and_runs_come_in_bounded_parts(both, spark):
    lib, enc = both
    path = queries.tokenizer_path()
    texts = ["the cat " * 20_000, "ing" * 40_000, "日本" * 9_000 + " x " + "a" * 50_000 + "<|endoftext|>" + "b1-" * 9_000, "x" * bpe.BLOCK + " y" * 70_000, "", " \n "]
    for text in texts:
        assert enc.encode(text) == ids(lib, text)
        assert max(map(len, enc.stream(text)), default=0) <= bpe.BLOCK
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    for r in bpe.bpe_digests(rows, path, with_ids=True).collect():
        want = ids(lib, [*texts, ""][r["doc_id"]])
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, want)), lib.decode(want, skip_special_tokens=False))]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) == (len(want), *digests, want)
