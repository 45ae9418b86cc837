"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding."""

from __future__ import annotations

import codecs
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space as the tokenizer's patterns see it.
_BLANK = "\t-\r \x85\xa0  -     　"
_CHUNK, _GAP = re.compile(f"[^{_BLANK}]+"), re.compile(f"[{_BLANK}]")
#: Python's split() also cuts at these, the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|[\x1c-\x1f]+", re.ASCII)
# The tokenizer library's Unicode tables are older than Python's for classes and marks, newer for capitals.
#: Letters and numbers of newer tables, which the library takes for symbols.
_NEWER_LETTERS = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1"
    r"\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24"
    r"\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5"
    r"\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD"
    r"\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
_NEWER_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
#: Marks of newer tables, which neither move nor compose when the library normalises.
_NEWER_MARKS = (
    r"\u07FD\u0898-\u089F\u08CA-\u08D3\u09FE\u0C3C\u0D3B-\u0D3C\u0EBA\u1715\u1ABF-\u1ACE\u1DF6-\u1DFA\uA82C\U00010D24-\U00010D27"
    r"\U00010EAB-\U00010EAC\U00010EFD-\U00010EFF\U00010F46-\U00010F50\U00010F82-\U00010F85\U00011070\U0001133B\U0001145E"
    r"\U00011839-\U0001183A\U00011930\U0001193D-\U0001193E\U00011943\U000119E0\U00011A34\U00011A47\U00011A99\U00011D42\U00011D44-\U00011D45"
    r"\U00011D97\U00011F41-\U00011F42\U00016FF0-\U00016FF1\U0001E08F\U0001E130-\U0001E136\U0001E2AE\U0001E2EC-\U0001E2EF\U0001E4EC-\U0001E4EF"
)
#: Capitals that the library lower-cases and Python doesn't yet.
_NEWER_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_MARK = re.compile(f"([{_NEWER_MARKS}])")
_NEWER = re.compile(f"[{_NEWER_LETTERS}{_NEWER_NUMBERS}{_NEWER_MARKS}{''.join(map(chr, _NEWER_CAPITALS))}]")
_LETTER, _NUMBER = rf"[\p{{L}}--[{_NEWER_LETTERS}]]", rf"[\p{{N}}--[{_NEWER_NUMBERS}]]"
_OTHER = rf"[[^{_BLANK}\p{{L}}\p{{N}}]||[{_NEWER_LETTERS}{_NEWER_NUMBERS}]]"
_PIECE_OF_ALL = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_NUMBER}|{_OTHER}+", regex.V1)
#: The same for a run that holds none of the code points above.
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANK}\p{{L}}\p{{N}}]+")
#: Characters of a text that are cut up at a time, and from which on a run without white space is not remembered.
BLOCK, LONG = 1 << 16, 1 << 12
#: Pieces, and chunks between white space, that a worker remembers.
PIECES, CHUNKS = 600_000, 250_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Recent:
    """A bounded map of the keys used of late: a full young generation becomes the old one, which is then forgotten."""

    def __init__(self, most: int):
        self._half, self.young, self._old = most // 2, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self._old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value):
        if len(self.young) >= self._half:
            self._old, self.young = self.young, {}
        self.young[key] = value
        return value


class MergeTable:
    """Vocabulary and merges of a word-end BPE file, prepared for left-to-right encoding.

    ``lookahead`` is the length in symbols of the longest token: a token that begins at or before a position ends
    within so many symbols of it, so nothing further away can move a boundary on which all open readings agree.
    """

    def __init__(self, spec: str):
        model = json.loads(spec)
        self.vocab: dict[str, int] = dict(model["model"]["vocab"])
        self.suffix: str = model["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.vocab.update(self.special)
        self.token = {i: t for t, i in self.vocab.items()}
        self.symbol = byte_symbols()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair = (self.vocab[a], self.vocab[b])
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(self.vocab[a + b], (rank, *pair))
        self.lookahead = max(len(t.removesuffix(self.suffix)) for t in self.vocab if t not in self.special)
        #: Tokens inside a word, with -1 for what only begins one, and tokens at the end of a word without its mark.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for t, i in self.vocab.items():
            if t in self.special:
                continue
            if t.endswith(self.suffix):
                self.final[t.removesuffix(self.suffix)] = i
            else:
                self.inner[t] = i
                for k in range(1, len(t)):
                    self.inner.setdefault(t[:k], -1)
        self._pieces = Recent(PIECES)
        self._pair: dict[tuple[int, int], bool] = {}
        self._spines: dict[tuple[int, int], list[tuple[int, float, float]]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """The parts of a token along its right (side 2) or left (side 1) edge: (part, when made, when used up)."""
        if (got := self._spines.get((token, side))) is None:
            got, end, part = [], float("inf"), token
            while True:
                made = self.parts[part][0] if part in self.parts else -1
                got.append((part, made, end))
                if made < 0:
                    break
                end, part = made, self.parts[part][side]
            self._spines[token, side] = got
        return got

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side: no merge across their border comes first.

        A part on the left's edge and one on the right's are neighbours while both exist. Their merge happens if it
        ranks before the merge that uses up either; of equal merges the one further left goes first.
        """
        if (got := self._pair.get((left, right))) is None:
            got, rank = True, self.rank
            for a, made_a, end_a in self._spine(left, 2):
                for b, made_b, end_b in self._spine(right, 1):
                    if made_a < end_b and made_b < end_a and (r := rank.get((a, b))) is not None and r < end_a and r <= end_b:
                        got = False
                        break
                if not got:
                    break
            if len(self._pair) >= PIECES:
                self._pair.clear()
            self._pair[left, right] = got
        return got

    def tokens(self, blocks: Iterable[str]) -> Iterator[int]:
        """Token ids of one piece, given as blocks of byte symbols without the word end, emitted once stable.

        For each prefix the transducer holds the last token of that prefix's encoding: the one token that ends there
        and may stand after the last token of the prefix before it. A position is expanded once the ``lookahead``
        symbols after it, and one more, are known. Any later token starts behind the positions still open, so where
        all of them go back through one boundary, what lies before it is final: it is emitted, and its states are
        dropped. What is held at a time does not grow with the piece as long as open readings meet again; the ids are
        right either way.
        """
        inner, final, pairs, most = self.inner, self.final, self._pair, self.lookahead
        held, token, origin = "", [-1], [0]
        at = 0
        for block in itertools.chain(blocks, (None,)):
            held += block or ""
            n = len(held)
            token += [-2] * (n + 1 - len(token))
            origin += [0] * (n + 1 - len(origin))
            while at < (n if block is None else n - most - 1):
                left = token[at]
                if left != -2:
                    for end in range(at + 1, min(at + most, n - (block is None)) + 1):
                        t = inner.get(held[at:end])
                        if t is None:
                            break
                        if t >= 0 and token[end] == -2:
                            ok = True if left == -1 else pairs.get((left, t))
                            if self.adjacent(left, t) if ok is None else ok:
                                token[end], origin[end] = t, at
                    if block is None and n - at <= most and token[n] == -2 and (t := final.get(held[at:])) is not None and (left == -1 or self.adjacent(left, t)):
                        token[n], origin[n] = t, at
                at += 1
            if block is not None and at >= 4 * most:
                # Walk the open readings back to where they first agree.
                open_at = {e for e in range(at, min(at + most, n) + 1) if token[e] != -2}
                while len(open_at) > 1:
                    latest = max(open_at)
                    open_at.remove(latest)
                    open_at.add(origin[latest])
                if stable := open_at.pop():
                    yield from self._path(token, origin, stable)
                    held, token, origin = held[stable:], token[stable:], [max(o - stable, 0) for o in origin[stable:]]
                    at -= stable
        yield from self._path(token, origin, len(held))

    @staticmethod
    def _path(token: list[int], origin: list[int], end: int) -> list[int]:
        out = []
        while end > 0 and token[end] != -2:
            out.append(token[end])
            end = origin[end]
        return out[::-1]

    def short(self, spelled: str) -> tuple[int, ...]:
        """What ``tokens`` gives for a piece that lies within the lookahead: one pass, then the path back."""
        inner, pairs, n = self.inner, self._pair, len(spelled)
        token, origin = [-1] + [-2] * n, [0] * (n + 1)
        for at in range(n):
            left = token[at]
            if left == -2:
                continue
            for end in range(at + 1, n):
                t = inner.get(spelled[at:end])
                if t is None:
                    break
                if t >= 0 and token[end] == -2:
                    ok = left == -1 or pairs.get((left, t))
                    if ok or (ok is None and self.adjacent(left, t)):
                        token[end], origin[end] = t, at
            if token[n] == -2 and (t := self.final.get(spelled[at:])) is not None and (left == -1 or self.adjacent(left, t)):
                token[n], origin[n] = t, at
        return tuple(self._path(token, origin, n))

    def piece(self, text: str) -> tuple[int, ...]:
        """Token ids of one piece of text."""
        got = self._pieces.get(text)
        if got is None:
            raw = text.encode()
            if len(raw) > self.lookahead:
                return tuple(self.tokens("".join([self.symbol[b] for b in raw[i : i + 256]]) for i in range(0, len(raw), 256)))
            spelled = "".join([self.symbol[b] for b in raw])
            whole = self.final.get(spelled)
            got = self._pieces.put(text, self.short(spelled) if whole is None else (whole,))
        return got


class Encoder:
    """Encodes texts: special tokens first, then chunks between white space, each normalised and cut into pieces."""

    def __init__(self, spec: str):
        self.table = MergeTable(spec)
        self._special = re.compile("|".join(re.escape(s) for s in self.table.special)) if self.table.special else None
        self._chunks = Recent(CHUNKS)

    @staticmethod
    def _prepared(chunk: str) -> tuple[re.Pattern | regex.Pattern, str]:
        """The pattern of a run's pieces, and the run (without white space) in normal form and lower case."""
        if chunk.isascii():
            return (_PIECE if _ODD.search(chunk) else _ASCII_PIECE), chunk.lower()
        newer = _NEWER.search(chunk)
        plain = "".join(unicodedata.normalize("NFC", part) for part in _MARK.split(chunk)) if newer else unicodedata.normalize("NFC", chunk)
        if newer:
            plain = plain.translate(_NEWER_CAPITALS)
        return (_PIECE_OF_ALL if newer else _PIECE), "".join(map(str.lower, plain)) if "Σ" in plain else plain.lower()

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        pattern, lower = self._prepared(chunk)
        pieces, piece = pattern.findall(lower), self.table.piece
        out = piece(pieces[0]) if len(pieces) == 1 else tuple([t for p in pieces for t in piece(p)])
        return self._chunks.put(chunk, out)

    def _long(self, chunk: str) -> Iterator[int]:
        """Ids of a run that is too long to be remembered, one by one."""
        symbol = self.table.symbol
        pattern, lower = self._prepared(chunk)
        for m in pattern.finditer(lower):
            p = m.group()
            if len(p) < LONG:
                yield from self.table.piece(p)
            else:
                yield from self.table.tokens("".join([symbol[b] for b in p[i : i + 256].encode()]) for i in range(0, len(p), 256))

    def _plain(self, text: str, lo: int, hi: int) -> Iterator[Sequence[int]]:
        while lo < hi:
            gap = _GAP.search(text, lo + BLOCK, hi)
            end = gap.start() if gap else hi
            block, lo = text[lo:end], end
            ids: list[int] = []
            known = self._chunks.young.get
            for chunk in block.split() if block.isascii() and not _ODD.search(block) else _CHUNK.findall(block):
                got = known(chunk)
                if got is None:
                    if len(chunk) >= LONG:
                        yield ids
                        ids = []
                        yield from itertools.batched(self._long(chunk), LONG)
                        continue
                    got = self._chunks.get(chunk) or self._chunk(chunk)
                    known = self._chunks.young.get
                ids += got
            yield ids

    def stream(self, text: str) -> Iterator[Sequence[int]]:
        """The ids of a text in runs of bounded length, each given out before the next block of text is cut up.

        Beside the text itself, what is held is a block, or the normal form of a run without white space if that is
        longer, and what ``MergeTable.tokens`` holds."""
        at = 0
        if self._special and "<" in text:
            for m in self._special.finditer(text):
                yield from self._plain(text, at, m.start())
                yield (self.table.special[m.group()],)
                at = m.end()
        yield from self._plain(text, at, len(text))

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(self.stream(text)))


class TokenText:
    """State machine from ids to the text that the library's ``decode`` gives where a tokenizer names no decoder:
    the tokens as written in the vocabulary, one space between two. State: whether a token came before."""

    def __init__(self, table: MergeTable):
        self._token, self._begun = table.token, False

    def feed(self, ids: Sequence[int]) -> str:
        out = " ".join(map(self._token.__getitem__, ids))
        if ids and self._begun:
            out = " " + out
        self._begun |= bool(ids)
        return out

    def close(self) -> str:
        return ""


class ByteText:
    """State machine from ids to readable text: tokens give bytes, word ends give a space, and bytes become text as
    soon as they complete a code point. State: the bytes of the open code point, and a pending space."""

    def __init__(self, table: MergeTable):
        byte = {s: b for b, s in enumerate(table.symbol)}
        self._bytes = lru_cache(maxsize=None)(lambda i: self._spell(table, byte, i))
        self._open, self._space = codecs.getincrementaldecoder("utf-8")("replace"), False

    @staticmethod
    def _spell(table: MergeTable, byte: dict[str, int], token: int) -> tuple[bytes, bool]:
        text = table.token[token]
        if text in table.special:
            return text.encode(), True
        ends = bool(table.suffix) and text.endswith(table.suffix)
        return bytes(byte[c] for c in (text.removesuffix(table.suffix) if ends else text)), ends

    def feed(self, ids: Sequence[int]) -> str:
        out = []
        for i in ids:
            raw, ends = self._bytes(i)
            if self._space:
                out.append(self._open.decode(b" "))
            out.append(self._open.decode(raw))
            self._space = ends
        return "".join(out)

    def close(self) -> str:
        return self._open.decode(b"", True)


#: Encoders of this Python worker by the digest of their file; one is in use at a time.
_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def _columns(docs: DataFrame, path: str, made: list[tuple[str, str, pa.DataType]], use: str, each: Callable[[Encoder, object], tuple]) -> DataFrame:
    """``docs`` without the column ``use``, plus the columns ``made``, of which ``each`` gives one row's values.

    The driver reads the vocabulary file and sends it to the executors; its size does not depend on the data."""
    names = {name for name, _, _ in made}
    keep = [f for f in docs.schema.fields if f.name != use and f.name not in names]
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):  # lists of ids of few texts at a time
                part = batch.slice(lo, 256)
                rows = [each(enc, x.as_py()) for x in part.column(use)]
                values = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in keep], *values], [*[f.name for f in keep], *[n for n, _, _ in made]])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{name} {kind}" for name, kind, _ in made]
    return docs.select(*[f"`{f.name}`" for f in keep], use).mapInArrow(run, ", ".join(fields))


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of ``text``. A null or empty text has no ids; repeated rows are
    encoded each; an empty table gives an empty result; a column called ``ids`` is replaced."""
    return _columns(docs, path, [("ids", "array<int>", pa.list_(pa.int32()))], "text", lambda enc, text: (enc.encode(text or ""),))


def bpe_decode(rows: DataFrame, path: str, readable: bool = False) -> DataFrame:
    """``rows`` with ``text`` in place of ``ids``: the library's text, or the bytes' text if ``readable``. Null: empty."""

    def each(enc: Encoder, ids) -> tuple[str]:
        machine = (ByteText if readable else TokenText)(enc.table)
        return (machine.feed(list(ids or [])) + machine.close(),)

    return _columns(rows, path, [("text", "string", pa.string())], "ids", each)


def bpe_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``docs`` with, in place of ``text``: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (and ``ids``, if asked
    for); see ``bpe_encode``. Texts run through encoder, decoder and digests block by block; only ``ids`` are kept whole."""

    def each(enc: Encoder, text) -> tuple:
        n, ids, machine = 0, [], TokenText(enc.table)
        spelled, decoded = hashlib.sha256(), hashlib.sha256()
        for run in filter(None, enc.stream(text or "")):
            spelled.update((" " * (n > 0) + " ".join(map(str, run))).encode())
            decoded.update(machine.feed(run).encode())
            n += len(run)
            if with_ids:
                ids += run
        decoded.update(machine.close().encode())
        found = n, spelled.hexdigest(), decoded.hexdigest()
        return (*found, ids) if with_ids else found

    made = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    made += [("ids", "array<int>", pa.list_(pa.int32()))] * with_ids
    return _columns(docs, path, made, "text", each)
