"""Bottom-k sketches of word shingles: mergeable fingerprints of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cohortlake.llm.common import mix64, partitions

K = 128
SHINGLE = 5
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of the shingles of words (A-Z lower-cased, split at ASCII white
    space), in text order.  Fewer words than a shingle are one shingle, no words none."""
    data = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = ~SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    # A word's hash: its bytes, scrambled with their place in the word, added up.
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(begin)
    coded = mix64((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(1))
    sums = np.r_[np.uint64(0), np.cumsum(coded, dtype=np.uint64)]
    words = mix64(sums[ends] - sums[starts])
    n = min(shingle, len(words))
    value = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        value = value * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j]
    return mix64(value ^ np.uint64(n))


def sketch(text: str, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    """The k least distinct shingle hashes, ascending."""
    hashes = shingle_hashes(text, shingle)
    if len(hashes) > 4 * k:
        # The k least distinct ones are among the least few, unless many repeat.
        least = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(least) >= k:
            return least[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of two texts; exact while both have
    fewer than k.  Two texts without shingles are alike."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, common, assume_unique=True).sum() / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 if ``a`` has none.

    Among the hashes up to the smaller of the two greatest kept ones both sketches are
    complete, so the share there is that of the whole.
    """
    if not len(a):
        return 1.0
    top = min((x[-1] for x in (a, b) if len(x) == k), default=np.uint64(2**64 - 1))
    own = a[a <= top]
    return float(np.isin(own, b).sum() / len(own)) if len(own) else 0.0


def _text(value) -> str:
    return "" if value is None else value


def document_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE
) -> DataFrame:
    """``id_col, fingerprint, distinct_shingles`` per row; null texts count as empty, whose
    fingerprint is an empty array.  Fingerprints are unsigned hashes kept as signed longs
    in the unsigned order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(_text(t), k, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f.view(np.int64) for f in found], type=pa.list_(pa.int64())),
                    pa.array([distinct_shingles(f, k) for f in found], type=pa.float64()),
                ],
                names=["id", "fingerprint", "distinct_shingles"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, fingerprint array<bigint>, distinct_shingles double")
    return found.withColumnRenamed("id", id_col)


def merged_fingerprints(parts: DataFrame, keys: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per key from those of its parts: the k least of all their hashes.

    Parts are merged in every task before the shuffle and again after it, a pair at a
    time, so a key with very many parts needs the memory of two sketches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))]))
            for name, part in zip(names, batch.column(len(keys)).to_pylist()):
                own = np.array(part or [], np.int64).view(np.uint64)
                known[name] = merge(known[name], own, k) if name in known else own
            if len(known) > 20_000:
                yield rows_of(known)
                known = {}
        if known:
            yield rows_of(known)

    def rows_of(known: dict) -> pa.RecordBatch:
        columns = [pa.array([n[i] for n in known], type=types[i]) for i in range(len(keys))]
        columns.append(pa.array([x.view(np.int64) for x in known.values()], type=pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=[*keys, column])

    rows = parts.select(*keys, column)
    types = [to_arrow_type(rows.schema[c].dataType) for c in keys]
    schema = T.StructType([*(rows.schema[c] for c in keys), T.StructField(column, T.ArrayType(T.LongType()))])
    partial = rows.mapInArrow(run, schema)
    # What is left of a key after the first merge is few rows: one a task.
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge_sorted(keys, column, k, types), schema)


def _merge_sorted(keys: list[str], column: str, k: int, types: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))]))
            done = []
            for name, part in zip(names, batch.column(len(keys)).to_pylist()):
                part = np.array(part or [], np.int64).view(np.uint64)
                if own is not None and name == last:
                    own = merge(own, part, k)
                else:
                    if own is not None:
                        done.append((last, own))
                    last, own = name, part
            if done:
                yield out(done)
        if own is not None:
            yield out([(last, own)])

    def out(done: list) -> pa.RecordBatch:
        columns = [pa.array([n[i] for n, _ in done], type=types[i]) for i in range(len(keys))]
        columns.append(pa.array([x.view(np.int64) for _, x in done], type=pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=[*keys, column])

    return run


def next_heads(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``part, id, text, extra``: the rows dealt to parts of neighbouring ids, each part
    followed (``extra``) by the first row of the next lower part that has any, so that a
    part knows the successor of each of its rows.  Rows go by descending id, null ids
    last, then by text; the lowest part is followed by the very first row.

    Texts move once.  The bounds of the parts are quantiles of the ids, one a partition.
    """
    count = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("x", F.col("id").cast("double"))
    bounds = rows.approxQuantile("x", [i / count for i in range(1, count)], 1 / (8 * count)) if count > 1 else []
    splits = [float("-inf"), *(sorted(set(bounds)) or [0.0]), float("inf")]
    of_id = Bucketizer(splits=splits, inputCol="x", outputCol="bucket", handleInvalid="keep")
    dealt = of_id.transform(rows.fillna(0.0, ["x"]))
    # Part 0 holds the greatest ids, the last one the null ids.
    part = F.when(F.col("id").isNull(), len(splits)).otherwise(len(splits) - F.col("bucket"))
    dealt = dealt.select(part.cast("int").alias("part"), "id", "text", F.lit(False).alias("extra"))
    # One row a part from here: its greatest id, and the part before it.
    top = dealt.groupBy("part").agg(F.max("id").alias("id"))
    order, everywhere = Window.orderBy("part"), Window.partitionBy()
    top = top.select(
        F.col("part").alias("of"),
        F.col("id").alias("most"),
        F.coalesce(F.lag("part").over(order), F.max("part").over(everywhere)).alias("to"),
    )
    first = (F.col("part") == F.col("of")) & F.col("id").eqNullSafe(F.col("most"))
    heads = dealt.join(F.broadcast(top), first).groupBy("to", "id")
    heads = heads.agg(F.min(F.struct(F.col("text").isNotNull().alias("full"), "text")).alias("first"))
    extra = heads.select(F.col("to").alias("part"), "id", F.col("first.text").alias("text"), F.lit(True).alias("extra"))
    both = dealt.unionByName(extra).repartition("part")
    return both.sortWithinPartitions("part", "extra", F.col("id").desc_nulls_last(), F.col("text").asc_nulls_first())


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE
) -> DataFrame:
    """Every row with its fingerprint and that of its edited text, and how near they are.

    The edited text has its last third (code points, rounded down) replaced by the first as
    many, or all, of the next row's text; rows go by descending id, the last is followed by
    the first (a single row by itself).  Null texts are empty; null ids come last and
    repeated ids go by text.  Returns ``id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, distinct_shingles``.
    """
    parts = next_heads(docs, id_col, text_col)
    list64 = pa.list_(pa.int64())
    schema = pa.schema(
        [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", list64),
         ("edited_fingerprint", list64), ("near_edited", pa.float64()), ("near_next", pa.float64()),
         ("distinct_shingles", pa.float64())]
    )

    def judged(row: tuple, follower: str, next_sketch: np.ndarray) -> tuple:
        ident, text, own = row
        m = len(text) // 3
        edited = text[: len(text) - m] + follower[:m]
        other = own if edited == text else sketch(edited, k, shingle)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (ident, len(text), digest, own.view(np.int64), other.view(np.int64), resemblance(own, other, k),
                resemblance(own, next_sketch, k), distinct_shingles(own, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part_of_last = None, None
        for batch in batches:
            done = []
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("part", "id", "text", "extra")]
            for part, ident, text, extra in zip(*columns):
                text = _text(text)
                if last is not None and part == part_of_last and last[1] == text:
                    own = last[2]
                else:
                    own = sketch(text, k, shingle)
                if last is not None and part == part_of_last:
                    done.append(judged(last, text, own))
                last, part_of_last = (None if extra else (ident, text, own)), part
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    found = parts.select("part", "id", "text", "extra").mapInArrow(
        run,
        "id bigint, n_chars bigint, edited_sha256 string, fingerprint array<bigint>, edited_fingerprint array<bigint>,"
        " near_edited double, near_next double, distinct_shingles double",
    )
    return found.withColumnRenamed("id", id_col)
