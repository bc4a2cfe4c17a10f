"""Near copies by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import fresh, settled, text_or_empty, utf8
from cohortlake.llm.components import connected_components

BITS = 64
SEED = 42
# Distances of so many pairs of fingerprints are held at once.
BLOCK = 1 << 20


def simhash(text: bytes, shingle: int) -> int:
    """The fingerprint of one text: a bit is set if over half the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.zeros(len(words), np.int64)
    np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
    ends = (starts + [len(w) for w in words])[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends)], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4
) -> DataFrame:
    """``id, fp`` (a signed long) and ``key`` (a digest of id and text) per row.  A-Z are lower-cased, words split at ASCII white
    space; a text with fewer words than a shingle is one shingle, one without words (or a
    null) has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            view = data.tobytes()
            fps = [simhash(view[s:e], shingle) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            fps = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, batch.column(2)], names=["id", "fp", "key"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), _row_key(id_col, text_col).alias("key"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint, key bigint")


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_or_empty(text_col))


def masks(radius: int) -> list[int]:
    """Bit masks of which at least one hides any ``radius`` positions.

    Every position has a non-zero vector of radius + 1 bits; mask v keeps the positions
    whose vector has an odd product with v.  The vectors of the differing positions span
    at most ``radius`` dimensions, so some v is orthogonal to them all.
    """
    if not 0 <= radius < 16:
        raise ValueError("the radius must be between 0 and 15")
    span = (1 << (radius + 1)) - 1
    vectors = [i % span + 1 for i in range(BITS)]
    return [
        sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, span + 1)
    ]


def tree_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is joined by distances up to the radius: a forest, not all pairs.

    Grows each tree by frontiers; a fingerprint already reached is compared no more.
    """
    heads, tails, todo = [], [], fps
    while len(todo) > 1:
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            reached = np.zeros(len(todo), bool)
            parent = np.zeros(len(todo), np.uint64)
            step = max(1, BLOCK // len(todo))
            for i in range(0, len(front), step):
                part, rest = front[i : i + step], np.flatnonzero(~reached)
                if not len(rest):
                    break
                close = np.bitwise_count(part[:, None] ^ todo[rest][None, :]) <= radius
                hit = close.any(axis=0)
                reached[rest[hit]] = True
                parent[rest[hit]] = part[close.argmax(axis=0)[hit]]
            heads.append(parent[reached])
            tails.append(todo[reached])
            front, todo = todo[reached], todo[~reached]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *heads]), np.concatenate([none, *tails])


def _bucket_links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(table: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(fp)])
        two = starts[sizes == 2]
        close = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        heads, tails = [fp[two][close]], [fp[two + 1][close]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            h, t = tree_links(np.unique(fp[s : s + n]), radius)
            heads.append(h)
            tails.append(t)
        a, b = np.concatenate(heads).view(np.int64), np.concatenate(tails).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now[2] = now[2].view(np.uint64)
            kept = [np.concatenate(x) for x in zip(kept, now)]
            # The last bucket may go on in the next batch.
            last = (kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1])
            end = int(np.argmax(last))
            if end:
                yield links_of(*[x[:end] for x in kept])
                kept = [x[end:] for x in kept]
        if len(kept[0]):
            yield links_of(*kept)

    return run


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs within the radius.

    ``fps`` holds distinct fingerprints.  Each goes to one bucket per mask; a pair within
    the radius meets in at least one.  Buckets are read in sorted order, one at a time,
    8 bytes a fingerprint; only links of a spanning forest leave them.
    """
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key"))
            for i, m in enumerate(masks(radius))
        ]
    )
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    dealt = dealt.repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(_bucket_links(radius), "a bigint, b bigint").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The rows ``id, fp, key`` of the documents, and ``node, root, component_id`` of every
    distinct fingerprint."""
    rows = settled(fingerprints(docs, id_col, text_col, shingle))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = settled(rooted)
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, rooted.join(first, "root").select(F.col("fp").alias("node"), "root", "component_id")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """``id_col, fp, component_id`` for every row of ``docs``.

    Rows link if their fingerprints differ in at most ``radius`` bits; component_id is the
    least id reachable over links (itself included).  Equal fingerprints are one node, so
    copies cost nothing beyond the first.  Null and empty texts have fingerprint zero and
    link like any other.  A null id takes part and gets its component's id, which is null
    only if no row of the component has an id.  Repeated rows stay repeated, other
    columns are not read, and an empty table gives no rows.
    """
    rows, of_fp = _grouped(docs, id_col, text_col, shingle, radius)
    return rows.join(of_fp, rows["fp"] == of_fp["node"], "left").select(
        F.col("id").alias(id_col), "fp", "component_id"
    )


def hex_fingerprint(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), BITS // 4, "0"))


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """One row of each group of near copies, with all its columns: that with the least id,
    null ids last; of rows with one id, the least by a digest of the text.

    Rows that share an id but not a group are judged each in its own.  Of rows equal in id
    and text one stays, whatever their other columns hold.  Null and empty texts are near
    copies of each other.  An empty table gives an empty one.
    """
    rows, of_fp = _grouped(docs, id_col, text_col, shingle, radius)
    rows = rows.join(of_fp, rows["fp"] == of_fp["node"]).select("root", "id", "key")
    # Equal rows are counted first, so that a large group is a few rows a task.
    counted = settled(rows.groupBy("root", "id", "key").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")
    best = counted.groupBy("root").agg(F.min(order).alias("best"))
    key, other, own = fresh(docs, "row_key", "other_id", "own_key")

    def those(found: DataFrame) -> DataFrame:
        return found.select(F.col("id").alias(other), F.col("key").alias(own))

    same = (F.col(key) == F.col(own)) & F.col(id_col).eqNullSafe(F.col(other))
    kept = best.select(F.col("root").alias("own_root"), "best")
    gone = counted.join(kept, F.col("root") == F.col("own_root"))
    gone = those(gone.filter((F.col("key") != F.col("best.key")) | ~F.col("id").eqNullSafe(F.col("best.id"))))
    left = docs.withColumn(key, _row_key(id_col, text_col)).join(gone, same, "left_anti")
    several = settled(those(best.select("best.*").filter("n > 1")))
    if not several.isEmpty():
        once = left.join(several, same, "left_semi").dropDuplicates([id_col, key])
        left = left.join(several, same, "left_anti").unionByName(once)
    return left.drop(key)
