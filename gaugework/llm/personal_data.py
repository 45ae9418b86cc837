"""Personal data: fixed forms by patterns, and other ways of writing them by a character tagger trained on labelled spans.

The patterns' matches in a bounded sample of the documents are the labelled spans. Each is also written in other ways (an
address with ``[at]``, a number with other separators), with new digits and letters, beside numbers that are none, and a
bidirectional LSTM with a CRF learns to tag them character by character. Texts are tagged in overlapping windows, and
the spans of all windows of a text are reconciled: the set of disjoint spans with the largest total score stays.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.sequence_tagger import Tagger, new_tagger, train

KINDS = ("email", "ip", "card", "phone")
#: Documents whose spans are learned (those with the smallest hash of their id), and windows taken from them at most.
TRAINING_DOCS, TRAINING_WINDOWS = 20_000, 2_000
#: Characters of a window, and from one window to the next: a span of half a window is whole in one, a longer one in a wider window.
WIDTH, STRIDE = 96, 48
#: Windows that are tagged in one step, and characters of text that are looked at in one.
BATCH, BLOCK = 1024, 1 << 20
SIZE, EPOCHS = 16, 8
#: Digits of the longest number of any kind (a card's).
MOST_DIGITS = 19

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits matches nothing that the run's start does not, so only those are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from each @ outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield lo, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the fixed forms: leftmost non-overlapping of each kind, failing ones dropped."""
    found = [("email", *span) for span in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


_AT = r"(?:\s?[@＠]\s?|\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s)"
_DOT = r"(?:\.|\s\.\s|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
_EMAIL_LIKE = re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_BARE_AT = re.compile(r"\sat\s", re.I)
#: After a country code (or none): three, three and four digits; or any groups after + or 00.
_PHONE_LIKE = re.compile(r"(?:\d{1,3}[\s./-]{0,3})?\(?\d{3}\)?[\s./-]{0,3}\d{3}[\s./-]?\d{4}|(?:\+|00)\d[\d\s()./-]+\d")
_IP_LIKE = re.compile(r"\D*?([0-9]{1,3})\D{1,5}([0-9]{1,3})\D{1,5}([0-9]{1,3})\D{1,5}([0-9]{1,3})")


def plausible(kind: str, text: str) -> bool:
    """Whether a tagged span can be what its tag says: the exact check after the tagger."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "email":
        # A bare "at" is a word of many sentences: the dot has to be written out too.
        return bool(_EMAIL_LIKE.fullmatch(text)) and (not _BARE_AT.search(text) or "dot" in text.lower())
    if kind == "ip":
        m = _IP_LIKE.fullmatch(text)
        return bool(m) and all(int(x) <= 255 for x in m.groups()) and len(set(re.findall(r"\D+", text))) == 1
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and len(set(re.findall(r"\D+", text))) <= 1
    return 10 <= len(digits) <= 15 and digits != text and bool(_PHONE_LIKE.fullmatch(text))


# Symbols: digits are one, letters of both cases are one each, so are the marks below; blanks; other letters; the rest; no text.
_MARKS = "@.,:;-_+()[]{}<>/\\#'\"=&%*!?|~$＠"
_PAD, _OTHER, _LETTER, _DIGITS, _BLANK, _LINE = range(6)
SYMBOLS = 6 + 26 + len(_MARKS)


def _table() -> np.ndarray:
    out = np.full(1 << 16, _OTHER, dtype=np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            out[i] = _LETTER
        elif c.isspace():
            out[i] = _LINE if c in "\r\n" else _BLANK
    out[48:58] = _DIGITS
    for i in range(26):
        out[[65 + i, 97 + i]] = 6 + i
    for i, c in enumerate(_MARKS):
        out[ord(c)] = 32 + i
    return out


_SYMBOL = _table()


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _SYMBOL[np.minimum(code, 0xFFFF)]


def allowed_steps() -> np.ndarray:
    """Tags are none (0), and for kind k its first character (1 + 2k) and those after it (2 + 2k)."""
    n = 1 + 2 * len(KINDS)
    out = np.ones((n + 1, n), dtype=bool)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = False
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return out


@dataclass
class _Writer:
    """Draws values of each kind, in fixed and in other forms, and numbers and marks that are none."""

    rng: random.Random

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def name(self, least: int = 2, most: int = 9) -> str:
        return "".join(self.rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.rng.randint(least, most)))

    def like(self, text: str) -> str:
        """Other letters and digits in the places of those of ``text``."""
        return re.sub("[0-9]", lambda _: self.rng.choice("0123456789"), re.sub("[a-z]", lambda _: self.rng.choice("abcdefghijklmnopqrstuvwxyz"), text))

    def card(self, n: int = 16) -> str:
        body = self.digits(n - 1)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def other(self, kind: str) -> str:
        pick = self.rng.choice
        if kind == "email":
            at, dot = pick([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), (" @ ", " . "), ("@", "[.]"), ("＠", "."), (" AT ", " DOT "), ("{at}", "{dot}")])
            host = dot.join([self.name(), pick(["com", "org", "net", "example", "co", self.name(2, 4)])] + ([pick(["uk", "com", "org"])] if self.rng.random() < 0.3 else []))
            return self.name() + pick(["", ".", "_"]) + pick(["", self.name(), self.digits(2)]) + at + host
        if kind == "ip":
            return pick(["[.]", " . ", "(.)", "[dot]", " dot ", "-dot-"]).join(str(self.rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            x = self.card()
            return pick([".", "/", "  ", "–", "_", " - ", " "]).join(x[i : i + 4] for i in range(0, 16, 4))
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"00{self.digits(2)} {a} {b} {c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"+{self.digits(2)}/{a}/{b}{c}"])

    def none(self) -> str:
        r, pick = self.rng, self.rng.choice
        return pick([
            f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", f"{r.randint(0, 23)}:{r.randint(0, 59):02}", self.digits(r.randint(1, 20)),
            f"{r.randint(1, 999)},{self.digits(3)},{self.digits(3)}.{self.digits(2)}", f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}", f"{r.randint(0, 9)}.{self.digits(r.randint(1, 9))}", f"{r.randint(1, 99)}-{r.randint(100, 999)}",
            f"@{self.name()}", f"{self.name()} @ {r.randint(1, 12)} pm", f"{self.name()} at {self.name()}. {self.name()}", "".join(r.choice("0123456789abcdef") for _ in range(r.randint(8, 40))), f"#{self.digits(5)}", f"{self.digits(4)} {self.digits(4)}",
            f"{r.randint(1, 40)} + {r.randint(1, 40)} = {r.randint(2, 80)}", f"{self.name()}.{self.name()}", f"{self.name()} dot {self.name()}", f"http://{self.name()}.com/{self.digits(4)}", f"({self.digits(2)})", f"AKIA{self.card(14)}", f"{self.digits(3)}.{self.digits(2)}.{self.digits(1)}",
        ])


def _example(parts: list[tuple[str, str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of the first WIDTH characters of ``parts`` put together: (text, its kind if it is a span)."""
    text = "".join(t for t, _ in parts)
    y = np.zeros(max(WIDTH, len(text)), dtype=np.int64)
    at = 0
    for t, kind in parts:
        if kind and t:
            k = KINDS.index(kind)
            y[at : at + len(t)] = 2 + 2 * k
            y[at] = 1 + 2 * k
        at += len(t)
    x = np.full(len(y), _PAD, dtype=np.uint8)
    x[: len(text)] = symbols(text)
    return x[:WIDTH], y[:WIDTH]


def examples(windows: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Training windows: each labelled one as it is, with its spans' letters and digits drawn anew, and with the spans written
    in other ways; and with the spans' places taken by what is none."""
    write, out = _Writer(random.Random(seed)), []
    for text, spans in windows:
        cuts, at = [], 0
        for kind, lo, hi in spans:
            cuts += [(text[at:lo], None), (text[lo:hi], kind)]
            at = hi
        cuts.append((text[at:], None))
        out.append(_example(cuts))
        if not spans:
            middle = write.rng.randint(0, len(text))
            out.append(_example([(text[:middle] + " ", None), (write.none(), None), (" " + text[middle:], None)]))
            continue
        for change in (lambda t, k: (write.like(t), k), lambda t, k: (write.other(k), k), lambda t, k: (write.other(o := write.rng.choice(KINDS)), o), lambda t, k: (write.none(), None)):
            out.append(_example([change(t, k) if k else (t, None) for t, k in cuts]))
    return np.stack([x for x, _ in out]), np.stack([y for _, y in out])


def labelled_windows(docs: DataFrame, most_docs: int = TRAINING_DOCS, most: int = TRAINING_WINDOWS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """At most ``most`` windows, half of them or more with spans of fixed forms, of the ``most_docs`` documents with the smallest
    hash of their id. The ids, and the windows of WIDTH characters at most, are of a bounded number each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                spans = sorted(base_spans(text), key=lambda s: s[1:])
                rng, reach = random.Random(f"{key}"), 0
                for i, (_, lo, hi) in enumerate(spans):
                    if lo < reach or hi - lo > WIDTH // 2:
                        continue
                    start = max(0, lo - rng.randint(0, WIDTH // 2))
                    near = []
                    for s in spans[max(0, i - 3) : i + 6]:
                        if s[1] >= max(start, near[-1][2] if near else 0) and s[2] <= start + WIDTH:
                            near.append((s[0], s[1] - start, s[2] - start))
                    rows.append((True, key, start, text[start : start + WIDTH], [{"kind": k, "lo": a, "hi": b} for k, a, b in near]))
                    reach = start + WIDTH
                start = rng.randint(0, max(0, len(text) - WIDTH))
                if text and all(hi <= start or lo >= start + WIDTH for _, lo, hi in spans):
                    rows.append((False, key, start, text[start : start + WIDTH], []))
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["some", "key", "start", "text", "spans"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = sample.mapInArrow(run, "some boolean, key long, start long, text string, spans array<struct<kind: string, lo: long, hi: long>>").dropDuplicates(["some", "key", "start", "text"])
    by = lambda some: found.where(F.col("some") == some).orderBy(F.xxhash64("key", "start"), "key", "start", "text").limit(most // 2)
    picked = by(True).union(by(False)).collect()
    return sorted(((r["text"], [(s["kind"], s["lo"], s["hi"]) for s in r["spans"]]) for r in picked), key=repr)


def fit(docs: DataFrame, seed: int = 0) -> Tagger | None:
    """A tagger trained on the labelled windows of ``docs``; none where these hold no span at all. Reruns agree."""
    windows = labelled_windows(docs)
    if not any(spans for _, spans in windows):
        return None
    x, y = examples(windows, seed)
    model = new_tagger(SYMBOLS, allowed_steps(), SIZE, seed)
    train(model, x, y, EPOCHS, seed=seed)
    return model


def _windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the windows of texts of these sizes: every STRIDE characters until the end is in one."""
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WIDTH) // STRIDE)), 0)
    text = np.repeat(np.arange(len(size)), count)
    return text, STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))


def _cued(x: np.ndarray) -> np.ndarray:
    """Places of ``x`` (symbols) with an @, the letters of dot, or those of at after an opening bracket: any address that
    ``plausible`` passes has one of these."""
    letter = lambda c: 6 + ord(c) - 97
    out = (x == 32) | (x == 32 + _MARKS.index("＠"))
    out[:-2] |= (x[:-2] == letter("d")) & (x[1:-1] == letter("o")) & (x[2:] == letter("t"))
    opened = np.isin(x, [32 + _MARKS.index(c) for c in "[({<"])
    opened[1:] |= opened[:-1] & np.isin(x[1:], [_BLANK, _LINE])
    out[1:-1] |= opened[:-2] & (x[1:-1] == letter("a")) & (x[2:] == letter("t"))
    return out


def tagged(model: Tagger, texts: list[str]) -> list[list[tuple[float, str, int, int]]]:
    """(score, kind, start, end) of the spans of all windows of each text that can hold a span.

    A span that the exact check passes has 4 digits or more or a cue (``_cued``), so windows with neither hold none whole. Spans at
    a window's edge inside the text are left to the window beside it; those too long for that are tagged again in windows
    twice as wide, until they are whole, but for numbers that have more digits than any kind.
    """
    out: list[list] = [[] for _ in texts]
    size = np.array([len(t) for t in texts], dtype=np.int64)
    lo = np.cumsum(size + WIDTH) - size - WIDTH
    x = np.full(int((size + WIDTH).sum()), _PAD, dtype=np.uint8)
    for t, a in zip(texts, lo, strict=True):
        x[a : a + len(t)] = symbols(t)
    text, start = _windows(size)
    if not len(text):
        return out
    sign, sure = (np.concatenate([[0], np.cumsum(c)]) for c in (x == _DIGITS, _cued(x)))
    at = lo[text] + start
    use = np.flatnonzero((sign[at + WIDTH] - sign[at] >= 4) | (sure[at + WIDTH] > sure[at]))
    text, start, width = text[use], start[use], WIDTH
    while len(text):
        wider: set[tuple[int, int]] = set()
        step = max(1, BATCH * WIDTH // width)
        for a in range(0, len(text), step):
            own, where = text[a : a + step], start[a : a + step]
            place = where[:, None] + np.arange(width)
            inside = place < size[own, None]
            tags, em = model.decode(np.where(inside, x[np.where(inside, lo[own, None] + place, 0)], np.uint8(_PAD)))
            for r, first in zip(*np.nonzero(tags % 2 == 1), strict=True):
                other = tags[r, first + 1 :] != tags[r, first] + 1
                end = first + 1 + (int(other.argmax()) if other.any() else len(other))
                t, kind, begin, stop = int(own[r]), KINDS[tags[r, first] // 2], int(where[r] + first), int(where[r] + end)
                left, right = first == 0 and where[r] > 0, end == width and where[r] + width < size[t]
                if left or right:
                    # The window beside this one, half a width on, does not hold it either.
                    long = (left and end >= width // 2) or (right and first <= width // 2)
                    if long and (kind == "email" or sign[lo[t] + stop] - sign[lo[t] + begin] <= MOST_DIGITS):
                        cell = begin // width  # windows of twice the width start at every width; the span starts before ``begin``
                        wider |= {(t, c * width) for c in range(max(0, cell - 2), cell + 1)}
                elif stop <= size[t]:
                    part = em[r, first:end]
                    score = float((part[np.arange(len(part)), tags[r, first:end]] - part[:, 0]).sum())
                    out[t].append((score, kind, begin, stop))
        again, width = sorted(wider), 2 * width
        text, start = (np.array([w[i] for w in again], dtype=np.int64) for i in range(2))
    return out


def reconciled(spans: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """The disjoint spans with the largest total score; equal spans of several windows add up. Ties: the earlier end."""
    total: dict[tuple[str, int, int], float] = {}
    for score, *span in spans:
        total[tuple(span)] = total.get(tuple(span), 0.0) + max(score, 1e-3)
    order = sorted(total, key=lambda s: (s[2], s[1], s[0]))
    ends = np.array([s[2] for s in order], dtype=np.int64)
    best, take = [0.0] * (len(order) + 1), [False] * len(order)
    before = [int(np.searchsorted(ends[:i], s[1], side="right")) for i, s in enumerate(order)]
    for i, s in enumerate(order):
        with_it = best[before[i]] + total[s]
        take[i] = with_it > best[i]
        best[i + 1] = max(best[i], with_it)
    out, i = [], len(order)
    while i:
        if take[i - 1]:
            out.append(order[i - 1])
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


def _order(s: tuple[str, int, int]) -> tuple:
    return s[1], KINDS.index(s[0]), s[2]


def scan(texts: list[str], model: Tagger | None) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans: those and the tagger's reconciled ones that pass the exact check and
    overlap none of them."""
    out, at = [], 0
    found: list[list] = [[] for _ in texts]
    while model and at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= BLOCK:
            size += len(texts[end])
            end += 1
        found[at:end] = tagged(model, texts[at:end])
        at = end
    for text, more in zip(texts, found, strict=True):
        base = sorted(base_spans(text), key=_order)
        spans = list(base)
        if more:
            right = np.maximum.accumulate([s[2] for s in base]) if base else np.zeros(0, np.int64)
            left = [s[1] for s in base]
            for kind, lo, hi in reconciled([s for s in more if plausible(s[1], text[s[2] : s[3]])]):
                k = int(np.searchsorted(left, hi))
                if not (k and right[k - 1] > lo):
                    spans.append((kind, lo, hi))
            spans.sort(key=_order)
        out.append((base, spans))
    return out


def find_personal_data(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """Every column of ``docs`` but ``text``, then ``base`` and ``spans``: arrays of (kind, start, end), code points of the
    whole text, end exclusive, by start, kind and end.

    A null or empty text has none; repeated rows are scanned each; an empty table gives an empty result; columns called
    ``base`` or ``spans`` are replaced. Without a model (a table whose sample holds no labelled span) both arrays are
    equal. A task holds one batch of texts, or a block of them, with some 10 bytes a character beside.
    """
    keep = [f for f in docs.schema.fields if f.name not in ("text", "base", "spans")]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            found = scan([x.as_py() or "" for x in batch.column("text")], model)
            sides = [pa.array([row(f[i]) for f in found], span) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], *sides], [*[f.name for f in keep], "base", "spans"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(*[f"`{f.name}`" for f in keep], "text").mapInArrow(run, f"{fields}base {kind}, spans {kind}")
