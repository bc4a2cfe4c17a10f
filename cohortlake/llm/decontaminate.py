"""Benchmark passages in training documents, found by spaced-seed hashing."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import fresh, settled, text_or_empty

# Each mask takes the words marked 1.  Together they hit every window of 13 words in
# which at most two differ.
MASKS = ("11101011", "110100111")
WINDOW = 13
SHARE = 0.8
LEAST_WORDS = 5
# Words that a mask for a short text takes, where its length allows.
MASK_WORDS = 6
# Rows up to which a side of two or three numbers a row is broadcast (some 8 MB).
SMALL_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def seeds(hashes: str, masks: list[str]) -> Column:
    """``(at, seed)`` of every place where a mask fits: the hash of the words it takes."""

    def seed_of(mask: str):
        places = [i for i, bit in enumerate(mask) if bit == "1"]
        return lambda at: F.struct(
            at.alias("at"), F.xxhash64(F.lit(mask), *[F.get(F.col(hashes), at + i) for i in places]).alias("seed")
        )

    empty = F.array().cast("array<struct<at:int,seed:bigint>>")
    found = []
    for mask in masks:
        starts = F.sequence(F.lit(0), F.size(hashes) - len(mask))
        found.append(F.when(F.size(hashes) >= len(mask), F.transform(starts, seed_of(mask))).otherwise(empty))
    return F.concat(*found)


def masks_for(n: int, share: float = SHARE) -> list[str]:
    """Masks of which one hits ``n`` words at some place, wherever the differences are that
    ``share`` allows: the words are cut into groups, and a mask leaves out as many groups as
    words may differ.  The fewest groups that leave ``MASK_WORDS`` words, else single words."""
    free = min(n - 1, n - math.ceil(share * n - 1e-9))
    groups = next((g for g in range(free + 1, n) if (g - free) * (n // g) >= MASK_WORDS), n)
    out = set()
    for gone in itertools.combinations(range(groups), free):
        out.add("".join(("0" if g in gone else "1") * (n // groups) for g in range(groups)).strip("0"))
    return sorted(out)


def when_small(df: DataFrame) -> DataFrame:
    """The frame settled, and marked for broadcast if it has at most ``SMALL_ROWS`` rows."""
    df = settled(df)
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS,
    window: int = WINDOW, share: float = SHARE, least_words: int = LEAST_WORDS, short: bool = False,
) -> DataFrame:
    """Which documents hold which benchmark texts: ``key, id_col, item_col, doc_start,
    item_start, n_window, n_equal, similarity``, a row per distinct document and text.

    Words are runs of letters and digits in lower case.  Where a mask takes equal words of
    a document and a text, the two are laid over each other there, and the pair is a leak
    if some window of ``window`` words (the whole text, if shorter) has at least ``share``
    of them equal, place by place.  Every window with at most two differing words is found;
    beyond that, pairs on which no mask agrees are not looked at.  The row names the best
    window: most equal words, then first in the document, then in the text.

    With ``short`` a text of fewer words than a window has the masks of its length, and every
    place where at least ``share`` of its words agree is found; without, it has the same masks
    as others, and one shorter than a mask is looked up whole.  A text of fewer than
    ``least_words`` words is no evidence and never found.  Of equal texts the least item id stands for all.
    Null texts have no words; repeated rows (same id and text) give one row; other columns
    are not read.  ``key`` is the digest of id and text that says which rows are meant.
    """
    items = benchmark.select(F.col(item_col).alias("item"), word_hashes(text_or_empty(item_text)).alias("iw"))
    items = settled(items.filter(F.size("iw") >= least_words).groupBy("iw").agg(F.min("item").alias("item")))
    items = items.withColumn("item_key", F.xxhash64("iw"))
    # Only lengths that occur add masks: those of the length, or one that takes every word.
    limit = window if short else min(map(len, masks))
    lengths = [r["n"] for r in items.select(F.size("iw").alias("n")).filter(F.col("n") < limit).distinct().collect()]
    of = {n: masks_for(n, share) if short else ["1" * n] for n in sorted(lengths)}
    every = list(dict.fromkeys([*masks, *itertools.chain(*of.values())]))
    own = seeds("iw", list(masks))
    for n, some in of.items():
        own = F.when(F.size("iw") == n, seeds("iw", some)).otherwise(own)
    marks = items.select("item_key", F.inline(own)).withColumnRenamed("at", "item_at")
    marks = when_small(marks)

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    hashed = texts.select(F.xxhash64("id", "text").alias("key"), "id", word_hashes(F.col("text")).alias("dw"))
    places = hashed.select("key", F.explode(seeds("dw", every)).alias("s")).select("key", "s.at", "s.seed")
    hits = places.join(marks, "seed").select("key", "item_key", (F.col("at") - F.col("item_at")).alias("shift"))
    hits = when_small(hits.distinct())

    laid = hashed.join(hits, "key").join(items, "item_key")
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("iw"), F.size("dw") - F.col("shift")) - 1
    laid = laid.withColumn("n", F.least(F.lit(window), F.size("iw"))).withColumn("first", first)
    laid = laid.withColumn("last", last).filter("last - first + 1 >= n")
    equal = F.transform(
        F.sequence("first", "last"), lambda j: (F.get("iw", j) == F.get("dw", j + F.col("shift"))).cast("int")
    )
    laid = laid.withColumn("equal", equal)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("equal") - F.col("n")),
        lambda s: F.struct(
            F.aggregate(F.slice("equal", s + 1, F.col("n")), F.lit(0), lambda a, x: a + x).alias("n_equal"),
            (-(F.col("first") + s + F.col("shift"))).alias("doc_start"),
            (-(F.col("first") + s)).alias("item_start"),
        ),
    )
    best = laid.select("key", "id", "item", "n", F.array_max(windows).alias("best"))
    best = best.filter(F.col("best.n_equal") >= F.ceil(F.lit(share) * F.col("n") - F.lit(1e-9)))
    best = best.groupBy("key", "id", "item", "n").agg(F.max("best").alias("best"))
    return best.select(
        "key",
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        (-F.col("best.doc_start")).alias("doc_start"),
        (-F.col("best.item_start")).alias("item_start"),
        F.col("n").alias("n_window"),
        F.col("best.n_equal").alias("n_equal"),
        (F.col("best.n_equal") / F.col("n")).alias("similarity"),
    )


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text, with all their columns."""
    (key,) = fresh(docs, "leak_key")
    gone = benchmark_leaks(docs, benchmark, id_col, text_col, **options).select(F.col("key").alias(key)).distinct()
    return docs.join(when_small(gone), F.xxhash64(F.col(id_col), text_or_empty(text_col)) == F.col(key), "left_anti")
