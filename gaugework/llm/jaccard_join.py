"""Jaccard similarity join of documents by word shingles, with signature trees, and the connected components of its links.

Sets meet where they can be linked at all: two sets with a similarity of at least t share one of their first
n - ceil(t n) + 1 shingles in any fixed order of all shingles. The order here puts shingles of crowded hash classes last.
All sets that share such a shingle are sent to the bucket of the smallest of them, as bitmaps of about n bits. In a bucket,
a signature tree (nodes hold the OR of their sets' token bitmaps and the range of sizes) is traversed against itself,
pruning pairs of nodes by the largest overlap they could have. Pairs that could be linked join sets into clusters; each
set is then sent, whole, to the one bucket of its cluster, where another tree leads to the pairs to verify.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm import repeats
from gaugework.llm.scratch import materialize
from gaugework.llm.textblocks import Words, blocks, mixed, signed, utf8_rows

#: Classes of a shingle's hash whose numbers of documents decide the order: a table of fixed size.
CLASSES = 1 << 16
#: Shingles of the sets of one cluster's bucket, and those that bitmaps of one bucket stand for; a bucket with more is
#: dealt into blocks, and each pair of blocks is a bucket.
BUCKET_SHINGLES, BITMAP_SHINGLES = 4_000_000, 100_000_000
#: Bytes of text whose sets are made at once: few, so that arrays of their words stay in a core's cache.
SET_BYTES = 1 << 18
#: Bitmaps show one of so many tokens.
SAMPLE = 4
FANOUT = 16
#: Sets of a bucket that are compared pair by pair, at most.
FEW = 24


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row of a block, sorted; a row of 1 to k - 1 words has one."""
    words = Words(data, offsets, lower=True)
    at, h = words.shingles(k)
    row = words.row[at]
    counts = np.diff(words.bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            have = counts[short] > i
            whole[have] = whole[have] * np.uint64(0xFF51AFD7ED558CCD) + words.hash[words.bounds[short[have]] + i]
        h = np.concatenate([h, mixed(whole + counts[short].astype(np.uint64) + np.uint64(k << 32))])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    at = np.searchsorted(row, np.arange(len(offsets))).tolist()
    for a, b in zip(at, at[1:], strict=False):  # rows are in order; a row's numbers alone are sorted without moving others
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _blocks_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row range, and the shingles of its rows: row, hash, and where each row's begin."""
    data, offsets = utf8_rows(batch.column("text"))
    for a, b in blocks(offsets, SET_BYTES):
        row, h = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
        yield a, b, row, h, np.searchsorted(row, np.arange(b - a + 1))


def _class(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def crowding(docs: DataFrame, k: int) -> np.ndarray:
    """For each class of shingles, the power of two of its share of all shingles: 0 for at most the average class.

    Counts cover all documents; whatever their number, CLASSES rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            for _, _, _, h, _ in _blocks_of(batch, k):
                total += np.bincount(_class(h), minlength=CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["class", "n"])

    rows = docs.select("text").mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(CLASSES)
    total[rows["class"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return np.floor(np.log2(np.maximum(total / max(total.mean(), 1e-9), 1))).astype(np.uint8)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _sets(crowd, k: int, percent: int):
    """Rows (id, tag, n, code, prefix, bits): size and hash of each document's set, its first shingles, and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = crowd.value
        for batch in batches:
            for a, b, row, h, cut in _blocks_of(batch, k):
                n = np.diff(cut)
                running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(0x51ED270B27B4F3CF)))])
                code = mixed(running[cut[1:]] - running[cut[:-1]] + n.astype(np.uint64))
                order = np.argsort((row << 8) | level[_class(h)], kind="stable")  # each row's are in order of their hash
                take = np.arange(len(h)) - cut[row] < prefix_length(n, percent)[row]
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, prefix_length(n, percent), 0))]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(h[order][take])))
                columns = [batch.column(c).slice(a, b - a) for c in ("id", "tag")]
                seen = pa.array([sampled_bits(h[cut[i] : cut[i + 1]]) for i in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(signed(code)), prefix, seen], ["id", "tag", "n", "code", "prefix", "bits"])

    return run


def sampled_bits(tokens: np.ndarray) -> bytes:
    """A bitmap of the tokens whose hash falls into the sample: a power of two of bits, at least 64 and the set's size."""
    bits = max(64, 1 << int(max(len(tokens), 1) - 1).bit_length())
    out = np.zeros(bits // 64, dtype=np.uint64)
    at = (tokens[(tokens >> np.uint64(40)) % np.uint64(SAMPLE) == 0] % np.uint64(bits)).astype(np.int64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out.tobytes()


def _routes(leader: int, own: int, parts: int) -> list[int]:
    """The buckets of a member: the leader's own, or one for each pair of blocks that holds the member's block."""
    if parts <= 1:
        return [leader]
    names = [f"{leader} {min(own % parts, other)} {max(own % parts, other)}".encode() for other in range(parts)]
    return [int.from_bytes(hashlib.blake2b(n, digest_size=8).digest(), "big", signed=True) for n in names]


def _deal(k: int):
    """Rows (route, code, tokens) that send each document's set to its cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("route", pa.int64()), ("code", pa.int64()), ("tokens", pa.binary())]
        for batch in batches:
            for a, b, _, h, cut in _blocks_of(batch, k):
                rows: list[tuple] = []
                for i, (code, cluster, parts) in enumerate(zip(*[batch.column(c).slice(a, b - a).to_pylist() for c in ("code", "cluster", "parts")], strict=True)):
                    body = h[cut[i] : cut[i + 1]].tobytes()
                    for route in _routes(cluster, code, parts):
                        rows.append((route, code, body))
                if rows:
                    yield repeats.emit(rows, fields)

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (route, code, n, bits) that send each member's bitmap to its buckets."""
    for batch in batches:
        rows = [(route, code, n, bits) for leader, code, n, bits, parts in zip(*[batch.column(c).to_pylist() for c in ("leader", "code", "n", "bits", "parts")], strict=True) for route in _routes(leader, code, parts)]
        if rows:
            yield repeats.emit(rows, [("route", pa.int64()), ("code", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])


class Components:
    """Sets of numbers 0 to n - 1 that grow together."""

    def __init__(self, n: int):
        self.root, self.joined = np.arange(n), 0

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, a: int, b: int) -> None:
        if (a := self.find(a)) != (b := self.find(b)):
            self.root[max(a, b)] = min(a, b)
            self.joined += 1

    def all(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up


class SignatureTree:
    """Levels of nodes over sets in order; each node covers FANOUT nodes of the level below. Bottom: one node a set.

    A node holds the OR of the bitmaps below it, the range of sizes, and the most tokens that a set below does not show as
    a bit of its own. Two sets share at most the bits that both show, and those that one of them does not show."""

    def __init__(self, bitmap: np.ndarray, size: np.ndarray):
        hidden = size - np.bitwise_count(bitmap).sum(axis=1).astype(np.int64)
        self.levels = [(bitmap, size, size, hidden)]
        while len(self.levels[-1][0]) > 1:
            bitmap, low, high, hidden = self.levels[-1]
            starts = np.arange(0, len(bitmap), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bitmap, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(hidden, starts)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether some set below node a and some below node b could be similar enough, by sizes and largest overlap."""
        bitmap, low, high, hidden = self.levels[level]
        ok = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        out = np.flatnonzero(ok)
        step = max(1, (1 << 21) // bitmap.shape[1])
        for i in range(0, len(out), step):
            x, y = a[out[i : i + step]], b[out[i : i + step]]
            overlap = np.bitwise_count(bitmap[x] & bitmap[y]).sum(axis=1).astype(np.int64) + np.minimum(hidden[x], hidden[y])
            ok[out[i : i + step]] = (100 + percent) * overlap >= percent * (low[x] + low[y])
        return ok

    def _whole(self, together: Components) -> list[np.ndarray]:
        """For each level, the component of nodes that lie in one as a whole, -1 - node for others."""
        top = together.all()
        out = [top]
        low = high = top
        for level in range(1, len(self.levels)):
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1 - np.arange(len(low))))
        return out

    def traverse(self, percent: int, together: Components, visit) -> None:
        """Calls ``visit`` for pairs of sets that could be similar enough and are not together yet.

        Pairs of nodes that lie in one component are left out. Components only grow, so what is known of them may be a
        little old: it is brought up to date now and then."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        whole, joined, since = self._whole(together), together.joined, 0
        while stack:
            level, a, b = stack.pop()
            since += 1
            if joined != together.joined and since >= 64:
                whole, joined, since = self._whole(together), together.joined, 0
            use = whole[level][a] != whole[level][b]
            if level:
                use |= whole[level][a] < 0  # a node of several components, with itself
            else:
                use &= a < b
            a, b = a[use], b[use]
            keep = self.possible(level, a, b, percent)
            if level == 0:
                for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                    if together.find(x) != together.find(y):
                        visit(x, y)
                continue
            below = len(self.levels[level - 1][0])
            for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                left, right = np.arange(x * FANOUT, min((x + 1) * FANOUT, below)), np.arange(y * FANOUT, min((y + 1) * FANOUT, below))
                p, q = np.repeat(left, len(right)), np.tile(right, len(left))
                once = p <= q
                stack.append((level - 1, p[once], q[once]))


def _few_groups(bitmaps: list[np.ndarray], size: list[int], percent: int) -> Components:
    """What ``possible_groups`` gives for a few sets, pair by pair: most buckets are so small that a tree costs more than it saves."""
    together = Components(len(bitmaps))
    length, bits = [64 * len(b) for b in bitmaps], [int.from_bytes(b.tobytes(), "little") for b in bitmaps]
    folded = [(b & ((1 << n // 2) - 1)) | (b >> n // 2) for n, b in zip(length, bits, strict=True)]
    hidden, hidden_folded = [[n - b.bit_count() for n, b in zip(size, form, strict=True)] for form in (bits, folded)]
    for j in range(1, len(size)):
        for i in range(j - 1, -1, -1):
            if 100 * size[i] < percent * size[j]:
                break  # sizes are in order
            if together.find(i) == together.find(j):
                continue
            if length[i] == length[j]:
                overlap = (bits[i] & bits[j]).bit_count() + min(hidden[i], hidden[j])
            elif 2 * length[i] == length[j]:
                overlap = (bits[i] & folded[j]).bit_count() + min(hidden[i], hidden_folded[j])
            else:
                continue
            if (100 + percent) * overlap >= percent * (size[i] + size[j]):
                together.join(i, j)
    return together


def possible_groups(bitmaps: list[np.ndarray], size: np.ndarray, percent: int) -> Components:
    """Sets (in order of size) grouped by pairs that their bitmaps do not rule out. Similar sets have bitmaps of equal
    lengths or one twice the other's, which is then folded; each length is a tree with those of twice the length."""
    if len(bitmaps) <= FEW:
        return _few_groups(bitmaps, size.tolist(), percent)
    together = Components(len(bitmaps))
    length = np.array([len(b) for b in bitmaps])
    for n in np.unique(length):
        own = np.flatnonzero((length == n) | (length == 2 * n))
        if len(own) < 2:
            continue
        folded = np.stack([bitmaps[i] if len(bitmaps[i]) == n else bitmaps[i][:n] | bitmaps[i][n:] for i in own])
        local, tree = Components(len(own)), SignatureTree(folded, size[own])
        first = np.arange(len(own) - 1)
        for i in np.flatnonzero(tree.possible(0, first, first + 1, percent)).tolist():  # neighbours in order
            local.join(i, i + 1)
        tree.traverse(percent, local, local.join)
        for i, top in zip(own.tolist(), local.all().tolist(), strict=True):
            together.join(i, int(own[top]))
    return together


def linked_groups(sets: list[np.ndarray], percent: int) -> Components:
    """Sets (in order of size) grouped by links of at least ``percent``."""
    size = np.array([len(s) for s in sets])
    bits = max(256, 1 << int(8 * size.max() - 1).bit_length())
    bitmap = np.zeros((len(sets), bits // 64), dtype=np.uint64)
    for i, s in enumerate(sets):
        at = (s % np.uint64(bits)).astype(np.int64)
        np.bitwise_or.at(bitmap[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    together = Components(len(sets))

    def verify(x: int, y: int) -> None:
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            together.join(x, y)

    for i in range(1, len(sets)):  # neighbours in order: copies mostly join here
        verify(i - 1, i)
    SignatureTree(bitmap, size).traverse(percent, together, verify)
    return together


def _grouped(name: str, percent: int):
    """Rows (code, other): each set of a bucket and the smallest code of its group there, where that is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                sizes = batch.column("n").to_pylist() if name == "bits" else [0] * batch.num_rows
                yield from zip(batch.column("route").to_pylist(), batch.column("code").to_pylist(), sizes, batch.column(name).to_pylist(), strict=True)

        out: list[tuple] = []
        for _, bucket in itertools.groupby(rows(), key=lambda r: r[0]):
            members = {code: (n, np.frombuffer(body, dtype=np.uint64)) for _, code, n, body in bucket}
            if len(members) < 2:
                continue
            if name == "bits":
                codes = sorted(members, key=lambda c: (members[c][0], c))
                groups = possible_groups([members[c][1] for c in codes], np.array([members[c][0] for c in codes]), percent)
            else:
                codes = sorted(members, key=lambda c: (len(members[c][1]), members[c][1][:1].tolist(), c))
                groups = linked_groups([members[c][1] for c in codes], percent)
            top = groups.all().tolist()
            least: dict[int, int] = {}
            for c, t in zip(codes, top, strict=True):
                least[t] = min(least.get(t, c), c)
            out += [(c, least[t]) for c, t in zip(codes, top, strict=True) if least[t] != c]
            if len(out) >= 10_000:
                yield repeats.emit(out, [("code", pa.int64()), ("other", pa.int64())])
                out = []
        if out:
            yield repeats.emit(out, [("code", pa.int64()), ("other", pa.int64())])

    return run


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (code, other): rows (code, label) for every node, the label its component's smallest.

    Each round takes the smallest label among a node and its neighbours and then the label's own label, so paths
    shorten by half; it ends when no label changes. Aggregations combine in each task first, so hubs cost no more.
    """
    links = materialize(links.select("code", "other"), "links")
    edges = links.union(links.select(F.col("other").alias("code"), F.col("code").alias("other"))).distinct()
    edges = materialize(edges, "edges")
    labels = materialize(edges.groupBy("code").agg(F.least("code", F.min("other")).alias("label")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("code").alias("other"), "label").hint("merge"), "other").groupBy("code").agg(F.min("label").alias("near"))
        low = labels.join(near.hint("shuffle_hash"), "code").select("code", F.least("label", "near").alias("low"), "label")
        jump = low.select(F.col("code").alias("low"), F.col("low").alias("far"))
        new = low.join(jump.hint("merge"), "low").select("code", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("changed"))
        new = materialize(new, "labels")
        labels = new.select("code", "label")
        if new.where("changed").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _components_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (id, tag, n, component) of keyed documents; see ``link_components``."""
    spark = docs.sparkSession
    crowd = spark.sparkContext.broadcast(crowding(docs, k))
    sets = materialize(docs.select("id", "tag", "text").mapInArrow(_sets(crowd, k, percent), "id long, tag long, n long, code long, prefix array<long>, bits binary"), "sets")
    one = F.struct("id", "tag", "n", "prefix", "bits")
    kinds = materialize(sets.where("n > 0").groupBy("code").agg(F.min(one).alias("one")).select("code", "one.*"), "kinds")

    first = kinds.select("code", "n", F.explode("prefix").alias("token"))
    leaders = first.groupBy("token").agg(F.min("code").alias("leader"), F.max("code").alias("last")).where("leader != last").select("token", "leader")
    members = materialize(first.join(leaders.hint("merge"), "token").select("leader", "code", "n").distinct(), "members")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda most: F.when(F.col("load") <= most, F.lit(1)).otherwise(F.ceil(2 * F.col("load") / most)).cast("int").alias("parts")
    loads = members.groupBy("leader").agg(F.sum("n").alias("load")).select("leader", parts(BITMAP_SHINGLES))
    spread = members.join(loads.hint("merge"), "leader").join(kinds.select("code", "bits").hint("merge"), "code").select("leader", "code", "n", "bits", "parts")
    spread = spread.mapInArrow(_spread, "route long, code long, n long, bits binary")
    near = spread.repartition(n, "route").sortWithinPartitions("route").mapInArrow(_grouped("bits", percent), "code long, other long")
    clusters = materialize(components(near).withColumnRenamed("label", "cluster").join(kinds.select("code", "id", "tag", "n").hint("shuffle_hash"), "code"), "clusters")

    loads = clusters.groupBy("cluster").agg(F.sum("n").alias("load")).select("cluster", parts(BUCKET_SHINGLES))
    wanted = clusters.join(loads.hint("merge"), "cluster").select("id", "tag", "code", "cluster", "parts")
    dealt = docs.select("id", "tag", "text").join(wanted.hint("shuffle_hash"), ["id", "tag"]).select("code", "cluster", "parts", "text")
    dealt = dealt.mapInArrow(_deal(k), "route long, code long, tokens binary")
    links = dealt.repartition(n, "route").sortWithinPartitions("route").mapInArrow(_grouped("tokens", percent), "code long, other long")
    labels = components(links)

    named = kinds.select("code", "id").join(labels.hint("shuffle_hash"), "code", "left").select("code", "id", F.coalesce("label", "code").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component"))
    names = named.join(least.hint("merge"), "label").select("code", "component")
    out = sets.select("id", "tag", "n", "code").join(names.hint("merge"), "code", "left")
    return out.select("id", "tag", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def link_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each document (``doc_id``, ``text``), by links of at least
    ``percent`` Jaccard similarity between sets of distinct ``k``-word shingles (A to Z lower-cased).

    The component's id is the smallest doc_id that links reach, the document's own included. With fewer than ``k``
    words the whole sequence is the one shingle; a null text or one without words has none and is linked with nothing.
    A null doc_id counts last: such a document has the smallest id it reaches, null if there is none. Repeated rows and
    exact copies are one set in the join, and come out each. An empty table gives an empty result; other columns are left
    out. No pair is lost: the shingles that are compared first are a sufficient prefix, and large buckets are split, not cut.
    """
    shown = lambda c: F.when(F.col(c) != repeats.LAST_ID, F.col(c))
    out = _components_of(repeats.keyed(docs), k, percent)
    return out.select(shown("id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row for each component of ``link_components``: the one with the smallest doc_id.

    A document without words is a component of its own. Of repeated rows (same doc_id and text) one stays.
    """
    parts = _components_of(repeats.keyed(docs), k, percent)
    first = parts.groupBy("component", F.when(F.col("n") > 0, F.lit(0)).otherwise(F.xxhash64("id", "tag")).alias("own")).agg(F.min(F.struct("id", "tag")).alias("one"))
    counts = parts.groupBy("id", "tag").agg(F.count("*").alias("copies"))
    stay = materialize(first.select(F.col("one.id").alias("__id"), F.col("one.tag").alias("__tag")).join(counts.withColumnsRenamed({"id": "__id", "tag": "__tag"}).hint("shuffle_hash"), ["__id", "__tag"]), "stay")
    keyed = docs.withColumn("__id", F.coalesce("doc_id", F.lit(repeats.LAST_ID))).withColumn("__tag", repeats.text_tag())
    kept = keyed.join(stay.hint("shuffle_hash"), ["__id", "__tag"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if stay.where("copies > 1").isEmpty():
        return kept.select(*columns)
    single = kept.where("copies = 1").select(*columns)
    return single.unionByName(kept.where("copies > 1").dropDuplicates(["__id", "__tag"]).select(*columns))
