"""I-Match document fingerprints over randomised subsets of an inverse-document-frequency band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.scratch import materialize

#: Lexicon subsets: LEVELS inclusion rates, each a quarter of the one before, with SUBSETS subsets each.
LEVELS, SUBSETS = 6, 16
#: Hexadecimal digits kept of each subset's hash.
DIGITS = 6


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct lower-cased words of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.transform(F.array_remove(F.array_distinct(words), ""), lambda w: F.xxhash64(w))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def lexicon(docs: DataFrame, least_df: int = 2, most_share: float = 0.05) -> tuple[list[int], DataFrame, DataFrame]:
    """What is outside the idf band, and what is known: the frequent terms, the rare terms of each row (row_key, rare), and
    all terms that are not rare (term). A term is rare if fewer than ``least_df`` rows of ``docs`` (row_key, text) hold
    it, and frequent if more than ``most_share`` of all rows (and more than ``least_df``) do.

    Each term is counted by its 64-bit hash. What reaches the driver is the frequent terms: at most the mean number of
    terms of a row over ``most_share``, whatever the number of rows.
    """
    pairs = docs.select("row_key", F.explode(terms(F.col("text"))).alias("term"))
    counts = materialize(pairs.groupBy("term").agg(F.count("*").alias("df"), F.min("row_key").alias("row_key")), "counts")
    most = max(least_df, int(docs.count() * most_share))
    frequent = sorted(r["term"] for r in counts.where(F.col("df") > most).select("term").collect())
    rare = counts.where(F.col("df") < least_df)
    rare = rare.select("row_key", "term") if least_df <= 2 else pairs.join(rare.select("term").hint("merge"), "term")
    rare = materialize(rare.groupBy("row_key").agg(F.collect_set("term").alias("rare")), "rare")
    return frequent, rare, counts.where(F.col("df") >= least_df).select("term")


def _without_frequent(every: Column, frequent: list[int]) -> Column:
    """``every`` less the frequent terms, which are a constant array."""
    if not frequent:
        return every
    return F.array_except(every, F.split(F.lit(",".join(map(str, frequent))), ",").cast("array<bigint>"))


def subset_bounds() -> list[list[int]]:
    """Where the subsets of each level begin and the last one ends: a subset is a range of term hashes, so a random part of
    the lexicon. The first level shares out all hashes, each next one the middle quarter of those before it."""
    return [[-(1 << 63 - 2 * k) + (i << 60 - 2 * k) for i in range(SUBSETS)] + [min(1 << 63 - 2 * k, (1 << 63) - 1)] for k in range(LEVELS)]


def with_fingerprints(df: DataFrame, columns: dict[str, str], frequent: list[int], rare: dict[str, str]) -> DataFrame:
    """``df`` with a fingerprint for each text column: number of kept terms, then one hash for each lexicon subset (a dot
    where the text has none of its terms).

    The kept terms are those in the band: neither in ``frequent`` nor in the column that ``rare`` names, the same rule for
    texts of any length. The sorted distinct kept terms of a subset are hashed; they lie side by side, between marks
    that are sorted in with them. Equal texts have equal fingerprints; a null or empty text, or one without terms in
    the band, has the count 0 and dots.
    """
    names = list(columns)
    bounds = subset_bounds()
    marks = sorted({b for level in bounds for b in level})
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",")
    # Each step is a projection of its own that is used more than once, so that no list is made again and again.
    df = df.withColumns({f"__kept_{c}": F.array_except(_without_frequent(terms(F.col(c)), frequent), F.coalesce(rare[c], _none())) for c in names})
    df = df.withColumns({f"__0_{c}": F.sort_array(F.concat(F.col(f"__kept_{c}"), numbers(marks).cast("array<bigint>"))) for c in names})
    made = ["kept", *range(LEVELS), *[f"at_{k}" for k in range(LEVELS)], *[f"part_{k}" for k in range(LEVELS)]]
    for k, level in enumerate(bounds):
        df = df.withColumns({f"__at_{k}_{c}": F.transform(numbers(level).cast("array<bigint>"), lambda m: F.array_position(f"__{k}_{c}", m).cast("int")) for c in names})  # noqa: B023
        # Marks of finer levels between those of a subset: they say nothing.
        own = numbers([marks.index(hi) - marks.index(lo) for lo, hi in zip(level, level[1:])]).cast("array<int>")

        def part(c: str, i: Column) -> Column:
            start, end = F.get(f"__at_{k}_{c}", i), F.get(f"__at_{k}_{c}", i + 1)  # noqa: B023
            hashed = F.xxhash64(F.slice(f"__{k}_{c}", start + 1, end - start - 1))  # noqa: B023
            return F.when(end - start == F.get(own, i), ".").otherwise(F.substring(F.lpad(F.lower(F.hex(hashed)), 16, "0"), 1, DIGITS))  # noqa: B023

        df = df.withColumns({f"__part_{k}_{c}": F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda i: part(c, i))) for c in names})  # noqa: B023
        if k + 1 < LEVELS:
            lo, hi = level.index(bounds[k + 1][0]), SUBSETS - level.index(bounds[k + 1][0])
            cut = lambda c: F.slice(f"__{k}_{c}", F.get(f"__at_{k}_{c}", F.lit(lo)), F.get(f"__at_{k}_{c}", F.lit(hi)) - F.get(f"__at_{k}_{c}", F.lit(lo)) + 1)  # noqa: E731, B023
            df = df.withColumns({f"__{k + 1}_{c}": cut(c) for c in names})
    df = df.withColumns({columns[c]: F.concat_ws(" ", F.size(f"__kept_{c}").cast("string"), *[F.col(f"__part_{k}_{c}") for k in range(LEVELS)]) for c in names})
    return df.drop(*[f"__{m}_{c}" for c in names for m in made])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of agreeing subsets, at the level whose subsets hold about one term of the longer text.

    At that rate, the chance that a subset with terms agrees is about the Jaccard similarity of the term sets.
    Equal fingerprints give 1; subsets that are empty on both sides do not count.
    """
    x, y = F.split(a, " "), F.split(b, " ")
    n = F.greatest(F.get(x, F.lit(0)).cast("int"), F.get(y, F.lit(0)).cast("int"))
    first = F.least(F.greatest(F.floor(F.log(F.greatest(n, F.lit(1)) / float(SUBSETS)) / F.log(F.lit(4.0)) + 0.5), F.lit(0)), F.lit(LEVELS - 1)).cast("int") * SUBSETS + 2
    pairs = F.arrays_zip(F.slice(x, first, SUBSETS).alias("x"), F.slice(y, first, SUBSETS).alias("y"))
    used = F.filter(pairs, lambda p: (p["x"] != ".") | (p["y"] != "."))
    same = F.size(F.filter(used, lambda p: p["x"] == p["y"]))
    return F.when(a == b, 1.0).when(F.size(used) == 0, 0.0).otherwise(same / F.size(used))


def _ranges(ids: DataFrame, buckets: int) -> DataFrame:
    """``ids`` (doc_id, row_key) with ``range`` and ``sub``, which together cut the order by descending doc_id (null ids
    last), then row_key, into parts: by range downwards, then by sub upwards. Ranges are cut at quantiles of the ids;
    null ids, and an id that fills a range by itself, are cut by the leading bits of their row keys."""
    edges = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000).alias("e")).first()["e"] or []
    crowded = sorted({a for a, b in zip(edges, edges[1:]) if a == b})
    array = lambda x: F.array(*[F.lit(int(e)).cast("long") for e in x]) if x else F.array().cast("array<bigint>")
    known = F.col("doc_id").isNotNull()
    alone = ~known | F.array_contains(array(crowded), F.col("doc_id"))
    below = F.size(F.filter(array(sorted(set(edges))), lambda e: e <= F.col("doc_id")))
    at = F.when(~known, F.lit(-1)).otherwise(2 * below + F.when(alone, 0).otherwise(1))
    sub = F.when(alone, F.shiftright("row_key", 56)).otherwise(0)
    return ids.withColumns({"range": at.cast("int"), "sub": sub.cast("int")})


def next_documents(docs: DataFrame, buckets: int = 256) -> DataFrame:
    """Each row key with that of the next document by descending doc_id (null ids last); after the last comes the first.
    Rows of one key (same id and text) are one document, and ``repeats`` says how many they are.

    Neighbours inside a range of ids come from a window over it, and the ranges' ends, one row each, are linked across
    ranges. Columns: row_key, n_chars, repeats, next_key.
    """
    ids = docs.select("doc_id", "row_key", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    ids = _ranges(materialize(ids.groupBy("doc_id", "row_key", "n_chars").agg(F.count("*").alias("repeats")), "ids"), buckets)
    inside = Window.partitionBy("range", "sub").orderBy(F.col("doc_id").desc_nulls_last(), F.col("row_key"))
    linked = ids.withColumn("next_key", F.lead("row_key").over(inside)).withColumn("is_first", F.row_number().over(inside) == 1)
    # One row for each range: its first key. The last row of a range goes on with the first of the next range.
    heads = linked.where("is_first").select("range", "sub", F.col("row_key").alias("head_key"))
    on = Window.orderBy(F.col("range").desc(), F.col("sub"))
    everything = Window.partitionBy()
    first = F.max(F.struct(F.col("range"), -F.col("sub"), F.col("head_key"))).over(everything)["head_key"]
    heads = heads.withColumn("below", F.coalesce(F.lead("head_key").over(on), first))
    out = linked.join(F.broadcast(heads.select("range", "sub", "below")), ["range", "sub"], "left")
    return out.select("row_key", "n_chars", "repeats", F.coalesce("next_key", "below").alias("next_key"))


def with_edited(docs: DataFrame) -> DataFrame:
    """One row for each id and text of ``docs`` (doc_id, row_key, text), plus ``edited``, ``next_key``, ``next_doc_id`` and
    ``repeats``, how many rows of ``docs`` it stands for.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's. Only that much of the next text moves; both joins read one shuffle of the texts.
    """
    links = materialize(next_documents(docs), "links")
    texts = docs
    if not links.where("repeats > 1").isEmpty():  # repeated rows meet once, so that joins don't multiply them
        counted = docs.join(links.select("row_key", "repeats").hint("shuffle_hash"), "row_key")
        texts = counted.where("repeats = 1").unionByName(counted.where("repeats > 1").dropDuplicates(["row_key"])).drop("repeats")
        texts = materialize(texts, "texts")
    needs = links.select(F.col("next_key").alias("row_key"), F.col("row_key").alias("for_key"), "repeats", F.floor(F.col("n_chars") / 3).cast("int").alias("k"))
    heads = texts.join(needs.hint("shuffle_hash"), "row_key").select(
        F.col("for_key").alias("row_key"), F.col("row_key").alias("next_key"), F.col("doc_id").alias("next_doc_id"), "repeats",
        F.coalesce(F.substring(F.col("text"), F.lit(1), F.col("k")), F.lit("")).alias("head"),
    )
    joined = texts.join(heads.hint("shuffle_hash"), "row_key")
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    return joined.withColumn("edited", F.concat(F.substring(text, F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("head"))).drop("head")


def fingerprints(docs: DataFrame, least_df: int = 2, most_share: float = 0.05) -> DataFrame:
    """``doc_id``, ``fingerprint`` of each row of ``docs`` (``doc_id``, ``text``). Nulls and empty texts: see
    ``with_fingerprints``. A text of any length is fingerprinted whole; repeated rows are fingerprinted each; other columns
    are left out; an empty table gives an empty result."""
    docs = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    frequent, rare, _ = lexicon(docs, least_df, most_share)
    docs = docs.join(rare.hint("shuffle_hash"), "row_key", "left")
    return with_fingerprints(docs, {"text": "fingerprint"}, frequent, {"text": "rare"}).select("doc_id", "fingerprint")


def edit_likeness(docs: DataFrame, least_df: int = 2, most_share: float = 0.05) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and how alike they are; see the functions above.

    Repeated rows (same doc_id and text) are one document with one next document, and come out each; documents that share
    an id or have none follow each other in the order of a hash of their texts. A single document is its own next
    one. Null and empty texts, which have no terms, are alike (1) among themselves and unlike (0) all that have some.
    Other columns are left out; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    frequent, rare, known = lexicon(docs, least_df, most_share)
    both = with_edited(docs)
    # Terms that only the edited text has: the next document's, and words that the cuts made, which no text may hold.
    added = both.select("row_key", F.explode(_without_frequent(F.array_except(terms(F.col("edited")), terms(F.col("text"))), frequent)).alias("term"))
    fresh = added.join(known.hint("merge"), "term", "left_anti").groupBy("row_key").agg(F.collect_set("term").alias("fresh"))
    fresh = materialize(fresh, "fresh")
    both = both.join(rare.hint("shuffle_hash"), "row_key", "left").join(fresh.hint("shuffle_hash"), "row_key", "left")
    both = both.withColumn("edited_rare", F.concat(F.coalesce("rare", _none()), F.coalesce("fresh", _none())))
    sizes = both.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).withColumn("edited_sha256", F.sha2(F.encode("edited", "utf-8"), 256))
    prints = with_fingerprints(sizes, {"text": "fingerprint", "edited": "edited_fingerprint"}, frequent, {"text": "rare", "edited": "edited_rare"})
    prints = prints.select("doc_id", "row_key", "next_key", "next_doc_id", "repeats", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
    prints = materialize(prints, "prints")
    other = prints.select(F.col("row_key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint"))
    out = prints.join(other.hint("shuffle_hash"), "next_key", "left").withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "next_doc_id",
    )
