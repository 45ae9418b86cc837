"""Secret scanning through nested encodings, with a worklist of decoded layers."""

from __future__ import annotations

import base64
import bisect
import codecs
import hashlib
import io
import re
import tempfile
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
#: Bytes of a decoded layer that are unpacked and looked at in one go.
PIECE = 16 << 20

_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4})+")
#: Parts of a percent run: bytes, and UTF-16 units.
_BYTES = re.compile(r"((?:%[0-9A-Fa-f]{2})+)|%u([0-9A-Fa-f]{4})")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ESCAPED = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/]{16,}|[A-Za-z0-9_-]{16,})={0,2}(?![A-Za-z0-9+/_=-])")
#: Base64 over two lines or more; the marks around PEM blocks are no part of it.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?!-)[A-Za-z0-9+/_-]{16,}(?<!-----)(?:\r?\n(?!-----)[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[^\r\n]+")
#: A run of the characters of both alphabets: base64, or a path or name that ends in base64 after one of ``_JOINT``.
_JOINED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_JOINT = re.compile(r"[+/_-]+")
_MARKS = (b"\xff\xfe", b"\xfe\xff")
#: After this, no match of any pattern goes on, here or in what it decodes to.
_BETWEEN = re.compile(r"""[^A-Za-z0-9+/_.=\-"'\x20:%\\\r\n{}&#;]|\n(?=\r?\n)""")


def find(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) in code points: leftmost non-overlapping matches of each kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


@dataclass
class Layer:
    """A text and, for each of its characters, the span of the document that it comes from and if it was decoded."""

    text: str
    start: array | range
    end: array | range
    decoded: bytearray | None


def _spliced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match replaced by its decoded characters; ``decode`` yields (character, width)."""
    text, start, end, fresh, at = [], array("q"), array("q"), bytearray(), 0
    old = layer.decoded

    def literal(lo: int, hi: int) -> None:
        text.append(layer.text[lo:hi])
        start.extend(layer.start[lo:hi])
        end.extend(layer.end[lo:hi])
        fresh.extend(old[lo:hi] if old else bytes(hi - lo))

    for m in pattern.finditer(layer.text):
        literal(at, m.start())
        pos = m.start()
        for char, width in decode(m[0]):
            text.append(char)
            start.append(layer.start[pos])
            end.append(layer.end[pos + width - 1])
            fresh.append(True)
            pos += width
        at = m.end()
    if not at:
        return None
    literal(at, len(layer.text))
    return Layer("".join(text), start, end, fresh)


def _percent(run: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for m in _BYTES.finditer(run):
        if m[1]:
            text = bytes.fromhex(m[1].replace("%", "")).decode(errors="surrogateescape")
            out += [("�", 3) if 0xDC80 <= ord(c) < 0xDD00 else (c, 3 * len(c.encode())) for c in text]
        else:
            out.append((chr(int(m[2], 16)), 6))
    return _paired(out)


def _escaped(run: str) -> list[tuple[str, int]]:
    codes = ((int(m[3] or m[1] or m[2], 10 if m[3] else 16), len(m[0])) for m in _ESCAPED.finditer(run))
    return _paired([(chr(code) if code < 0x110000 else "�", width) for code, width in codes])


def _paired(units: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The characters with surrogate pairs joined to one; single surrogates are replaced."""
    out: list[tuple[str, int]] = []
    for char, width in units:
        if "\udc00" <= char < "\ue000" and out and "\ud800" <= out[-1][0] < "\udc00":
            high, before = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + ord(char) - 0xDC00), before + width))
        else:
            out.append((char, width))
    return [("�" if "\ud800" <= c < "\ue000" else c, w) for c, w in out]


def _packed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] & 0x0F == 8 and (head[0] << 8 | head[1]) % 31 == 0)


def _unpack(source: IO[bytes]) -> tuple[IO[bytes], bytes, bool, bytes]:
    """What all members of ``source`` unpack to (beyond PIECE bytes in an unlinked file), its digest, whether the last
    member is whole, and the bytes after it."""
    out, digest, data = tempfile.SpooledTemporaryFile(PIECE), hashlib.blake2b(), source.read(PIECE)
    while True:
        engine = zlib.decompressobj(47)
        try:
            while data and not engine.eof:
                got = engine.decompress(data, PIECE)
                data = engine.unconsumed_tail or (engine.unused_data if engine.eof else source.read(PIECE))
                digest.update(got)
                out.write(got)
            if not engine.eof:
                got = engine.flush()
                digest.update(got)
                out.write(got)
        except zlib.error:
            return out, digest.digest(), False, b""
        data += source.read(3) if engine.eof and len(data) < 3 else b""
        if not engine.eof or not _packed(data[:3]):
            return out, digest.digest(), engine.eof, data + source.read()


def _contents(raw: bytes) -> Iterator[IO[bytes]]:
    """The bytes, or what they unpack to if they are compressed, until nothing more unpacks; of a broken stream, also its
    bytes as they are. A stream that unpacks to one seen before (itself, say) ends there."""
    work: list[IO[bytes]] = [io.BytesIO(raw)]
    seen: set[bytes] = set()
    while work:
        with work.pop() as source:
            head = source.read(3)
            source.seek(0)
            whole = False
            if _packed(head):
                out, digest, whole, rest = _unpack(source)
                if out.tell() and digest not in seen:
                    seen.add(digest)
                    out.seek(0)
                    work.append(out)
                if rest:
                    work.append(io.BytesIO(rest))
                source.seek(0)
            if not whole:
                yield source


def _pieces(source: IO[bytes], encoding: str) -> Iterator[str]:
    """The bytes as text, in pieces of about PIECE bytes, cut where nothing that is looked for can go on."""
    source.seek(0)
    decoder = codecs.getincrementaldecoder(encoding)("replace")
    text = ""
    while data := source.read(PIECE):
        known = max(len(text) - 2, 0)
        text += decoder.decode(data)
        for lo in range(len(text) - 4096, known - 4096, -4096):
            if cuts := [m.end() for m in _BETWEEN.finditer(text, max(lo, known), lo + 4096)]:
                yield text[: cuts[-1]]
                text = text[cuts[-1] :]
                break
    if text := text + decoder.decode(b"", True):
        yield text


def _texts(raw: bytes) -> Iterator[str]:
    """The text of the bytes, unpacked; invalid bytes are replaced. What has a NUL or a mark of UTF-16 is also read as
    UTF-16, in both byte orders."""
    if not _packed(raw[:3]) and b"\0" not in raw and raw[:2] not in _MARKS:
        yield raw.decode(errors="replace")
        return
    for source in _contents(raw):
        yield from _pieces(source, "utf-8")
        source.seek(0)
        wide = source.read(2) in _MARKS
        while not wide and (data := source.read(PIECE)):
            wide = b"\0" in data
        for encoding in ("utf-16-le", "utf-16-be") if wide else ():
            yield from _pieces(source, encoding)


def _decoded(body: str) -> bytes | None:
    body = body.rstrip("=").translate({45: "+", 95: "/"})
    return base64.b64decode(body + "=" * (-len(body) % 4)) if len(body) % 4 != 1 else None


def _base64_runs(text: str) -> Iterator[tuple[bytes, int, int]]:
    """The bytes of each base64 run and its place: runs inside a line, and runs over lines of one width (the last may be
    shorter, the first too if it does not begin its line)."""
    for m in _BASE64.finditer(text):
        if (raw := _decoded(m[0])) is not None:
            yield raw, m.start(), m.end()
    for m in _WRAPPED.finditer(text):
        lines = [x.span() for x in _LINE.finditer(text, m.start(), m.end())]
        size = [hi - lo for lo, hi in lines]
        first = 0
        while first < len(lines) - 1:
            to = first + 1
            # A first line after other text may be shorter than those after it.
            inside = first == 0 and lines[0][0] > 0 and text[lines[0][0] - 1] != "\n"
            starts = [(first, size[first])] + ([(first, size[first + 1])] if inside and size[first + 1] > size[first] else [])
            for at, width in starts:
                end = at + 1
                while end < len(lines) and size[end] == width:
                    end += 1
                full = end
                end += end < len(lines) and size[end] < width
                # What comes after the last full line may be a word of the text, or the run's end.
                for last in dict.fromkeys((end, full)):
                    body = "".join(text[lo:hi] for lo, hi in lines[at:last])
                    if last - at > 1 and len(body) >= 16 and not (set("+/") & set(body) and set("-_") & set(body)) and (raw := _decoded(body)) is not None:
                        yield raw, lines[at][0], lines[last - 1][1]
                        break
                to = max(to, end)
            first = to


def _later(run: str) -> tuple[list[list[int]], list[int]]:
    """Places in a run, after a joint, where base64 may begin: those of each alignment (all of them decode to ends of
    what the first decodes to), and those where something compressed begins."""
    body = run.rstrip("=")
    by_place: dict[int, list[int]] = {}
    packed = []
    for m in _JOINT.finditer(body):
        if len(body) - m.end() >= 16:
            by_place.setdefault(m.end() % 4, []).append(m.end())
            if _packed(_decoded(body[m.end() : m.end() + 4]) or b""):
                packed.append(m.end())
    return list(by_place.values()), packed


def _tail(run: str, at: int) -> bytes:
    body = run.rstrip("=")[at:]
    return _decoded(body[: len(body) - (len(body) % 4 == 1)]) or b""


def _unpacked_tail(run: str, at: int) -> bytes:
    """What base64 from ``at`` holds if a compressed stream begins there, still packed; of a stream with a fault, what
    unpacks before it. It is read in growing parts up to the fault, so that a place that only looks packed costs no more
    than that. (The bytes as they are belong to the alignment of the place, which is read once.)"""
    body, engine, lo, size, out = run.rstrip("="), zlib.decompressobj(47), at, 256, []
    while lo < len(body) and not engine.eof and sum(map(len, out)) < PIECE:
        part = body[lo : lo + size]
        try:
            out.append(engine.decompress(_decoded(part[: len(part) - (len(part) % 4 == 1)]) or b"", PIECE))
            while engine.unconsumed_tail and sum(map(len, out)) < PIECE:
                out.append(engine.decompress(engine.unconsumed_tail, PIECE))
        except zlib.error:
            return b"".join(out)
        lo, size = lo + size, min(2 * size, PIECE)
    return _tail(run, at)


def _joined_kinds(run: str, whole: bool) -> set[tuple[str, int]]:
    """(kind, place) of secrets in base64 that begins after a joint of the run: a path, a name. The last place that
    shows the secret counts. ``whole``: the run from its start has been decoded."""
    places, packed = _later(run)
    found: set[tuple[str, int]] = set()
    for at in packed:
        found.update((kind, at) for kind in _kinds(_unpacked_tail(run, at)))
    for starts in places:
        if whole and starts[0] % 4 == 0:
            continue
        for kind in _kinds(_tail(run, starts[0])):
            past = bisect.bisect_left(starts, True, lo=1, key=lambda at: kind not in _kinds(_tail(run, at)))  # noqa: B023
            found.add((kind, starts[past - 1]))
    return found


def _children(text: str) -> Iterator[str]:
    for pattern, decode in ((_PERCENT, _percent), (_ESCAPE, _escaped)):
        if pattern.search(text):
            yield pattern.sub(lambda m: "".join(c for c, _ in decode(m[0])), text)  # noqa: B023
    for raw, _, _ in _base64_runs(text):
        yield from _texts(raw)
    for m in _JOINED.finditer(text):
        places, packed = _later(m[0])
        for at in packed:
            yield from _texts(_unpacked_tail(m[0], at))
        for starts in places:
            yield from _texts(_tail(m[0], starts[0]))


def _kinds(raw: bytes) -> set[str]:
    """The kinds of secrets in the content of a base64 run and in all layers inside it. They all map to the whole run."""
    found: set[str] = set()
    seen: set[bytes] = set()
    work = [_texts(raw)]
    while work and len(found) < len(KINDS):
        if (text := next(work[-1], None)) is None:
            work.pop()
            continue
        key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in seen:
            seen.add(key)
            found.update(kind for kind, _, _ in find(text))
            work.append(_children(text))
    return found


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the base ones and those of decoded layers, mapped to the document.

    A worklist starts with the text itself. From each layer come its percent-decoded text, its text with Unicode
    escapes and character references resolved, until nothing new comes; layers seen before, by text and map, are not
    taken up again. The content of each base64 run (unpacked if compressed, all of it) is taken through the same steps by
    ``_kinds``, and so is what begins after a joint of a run. A match in a layer counts if a decoded character is in it;
    it is mapped to the document's span that its characters come from.
    """
    base = find(text)
    spans = set(base)
    work = deque([Layer(text, range(len(text)), range(1, len(text) + 1), None)])
    seen: set[bytes] = set()
    known: dict[bytes, set[str]] = {}
    while work:
        layer = work.popleft()
        if layer.decoded is not None:
            for kind, lo, hi in find(layer.text):
                if any(layer.decoded[lo:hi]):
                    spans.add((kind, layer.start[lo], layer.end[hi - 1]))
        children: list[Layer] = []
        if "%" in layer.text and (child := _spliced(layer, _PERCENT, _percent)):
            children.append(child)
        if ("\\" in layer.text or "&#" in layer.text) and (child := _spliced(layer, _ESCAPE, _escaped)):
            children.append(child)
        alone: dict[int, set[str]] = {}
        for raw, lo, hi in _base64_runs(layer.text):
            if raw not in known:
                known[raw] = _kinds(raw)
            new = known[raw]
            if "\n" not in layer.text[lo:hi]:
                alone[lo] = new
            elif layer.text.count("\n", lo, hi) == 1 and layer.text.find("\n", lo) - lo < 60:
                new = new - alone.get(lo, set())  # a short line that is whole without the next
            spans.update((kind, layer.start[lo], layer.end[hi - 1]) for kind in new)
        for m in _JOINED.finditer(layer.text):
            if _JOINT.search(m[0]):
                found = _joined_kinds(m[0], m.start() in alone)
                spans.update((kind, layer.start[m.start() + at], layer.end[m.end() - 1]) for kind, at in found)
        for child in children:
            key = hashlib.blake2b(child.text.encode("utf-8", "surrogatepass"), digest_size=16)
            key.update(child.start.tobytes())
            key.update(child.end.tobytes())
            key = key.digest()
            if child.text and key not in seen:
                seen.add(key)
                work.append(child)
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (s[1], rank[s[0]], s[2])
    return sorted(base, key=order), sorted(spans, key=order)


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _keep(docs: DataFrame, without: tuple[str, ...]) -> list:
    return [f for f in docs.schema.fields if f.name not in without]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` but ``text``, then ``base`` and ``spans``: both arrays of (kind, start, end), code
    points of the whole text, end exclusive. A null or empty text has none; repeated rows are scanned each; an empty
    table gives an empty result; columns called ``base`` or ``spans`` are replaced."""
    keep = _keep(docs, ("text", "base", "spans"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            base, spans = [], []
            for value in batch.column("text"):
                a, b = scan(value.as_py() or "")
                base.append(row(a))
                spans.append(row(b))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], pa.array(base, span), pa.array(spans, span)], [*[f.name for f in keep], "base", "spans"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(*[f"`{f.name}`" for f in keep], "text").mapInArrow(run, f"{fields}base {kind}, spans {kind}")


def redacted(text: str) -> str:
    """The text with each run of overlapping secret spans replaced by a mark that names the first's kind."""
    out, at, reach = [], 0, -1
    for kind, lo, hi in scan(text)[1]:
        if lo < reach:
            at = reach = max(reach, hi)
            continue
        out += [text[at:lo], f"[{kind} removed]"]
        at = reach = hi
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by marks, and ``n_chars`` (if there) brought up to date."""
    names = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (v := x.as_py()) is None else redacted(v) for x in batch.column("text")]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([old.as_py() if t is None else len(t) for t, old in zip(texts, columns[i], strict=True)], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
