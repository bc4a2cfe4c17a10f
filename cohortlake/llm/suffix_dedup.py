"""Byte strings that repeat across documents, by blockwise suffix sorting with a difference cover.

Suffixes are compared by their first ``least`` bytes, which is all that decides whether a
string of that length repeats.  A suffix goes to the bucket of the least k-gram hash in
those bytes (its minimiser), so equal ones meet; neighbouring suffixes of one bucket travel
as one piece of text.  Buckets are sorted one block at a time; one that may be larger than
a block is dealt out by the hash of the whole string instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import fresh, in_chunks, mix64, release, remove, stored, stored_at, text_or_empty, utf8

LEAST = 50
GRAM = 16
# Positions mod 7 whose suffixes are ranked beforehand: any two residues r, s have a shift
# d < 7 with (r + d) mod 7 and (s + d) mod 7 both in it.
PERIOD, COVER = 7, (0, 1, 3)
# Bytes hashed at a time (they stay in the processor's cache), and bytes of pieces sorted at a time.
HASH_BYTES = 1 << 16
BLOCK_BYTES = 1 << 20
# A bucket of more pieces than this (some 3 MB; equal ones count once a batch) is split.
HOT_PIECES = 1 << 15
# The filter of repeated minimisers has 16 bits for each, and at most so many in all (32 MiB).
MOST_BITS = 1 << 28
LAST_ID = (1 << 63) - 1


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes at every position, built from those of 1, 2, 4, ... bytes."""
    part = mix64(data.astype(np.uint64) + np.uint64(1))
    base, size, done, whole = 0x9E3779B97F4A7C15, 1, 0, None
    while True:
        if k & size:
            if whole is None:
                whole, done = part, size
            else:
                n = len(data) - done - size + 1
                whole, done = whole[:n] * np.uint64(base) + part[done : done + n], done + size
        if done == k:
            return mix64(whole)
        part = part[: len(part) - size] * np.uint64(base) + part[size:]
        base, size = base * base % (1 << 64), 2 * size


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def pieces(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``hash, start, count``: runs of at most ``least`` neighbouring suffixes with the same
    minimiser, within documents that lie end to end.  A run is ``count + least - 1`` bytes."""
    found = []
    begins, ends = offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - least + 1)
    for a in range(0, len(data) - least + 1, HASH_BYTES):
        part = data[a : a + HASH_BYTES + least - 1]
        value = sliding_min(gram_hashes(part, gram), least - gram + 1)
        n = len(value)
        # Suffixes shorter than ``least`` are none.
        i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(begins, a + n, side="left")
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.clip(begins[i:j] - a, 0, n), 1)
        np.add.at(edge, np.clip(ends[i:j] - a, 0, n), -1)
        valid = np.cumsum(edge[:n]) > 0
        new = np.r_[True, (value[1:] != value[:-1]) | (valid[1:] != valid[:-1])]
        starts = np.flatnonzero(new)
        counts = np.diff(np.r_[starts, n])
        starts, counts = starts[valid[starts]], counts[valid[starts]]
        if len(counts) and counts.max() > least:  # repeated grams: cut long runs
            cuts = -(-counts // least)
            at = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            counts = np.minimum(np.repeat(counts, cuts) - at * least, least)
            starts = np.repeat(starts, cuts) + at * least
        found.append((value[starts], starts + a, counts))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def split_hot(
    data: np.ndarray, value: np.ndarray, start: np.ndarray, count: np.ndarray, hot: np.ndarray, least: int
) -> tuple[np.ndarray, ...]:
    """The pieces, and for each whether its minimiser is among ``hot`` (sorted); those are cut
    into their suffixes, each in the bucket of the hash of its first ``least`` bytes."""
    at = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
    inside = hot[at] == value
    if not inside.any():
        return value, start, count, inside
    sizes = np.where(inside, count, 1)
    of = np.repeat(np.arange(len(value)), sizes)
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value, start, count, inside = value[of], start[of] + step, np.where(inside, 1, count)[of], inside[of]
    where = start[inside]
    hashes = np.empty(len(where), np.uint64)
    for a in range(0, len(where), HASH_BYTES // 8):
        rows = where[a : a + HASH_BYTES // 8]
        windows = data[rows[:, None] + np.arange(least)]
        got = np.zeros(len(rows), np.uint64)
        for i in range(least):
            got = mix64(got + windows[:, i].astype(np.uint64) + np.uint64(1))
        hashes[a : a + HASH_BYTES // 8] = got
    value[inside] = hashes
    return value, start, count, inside


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix64(hashes + np.uint64(i)) & np.uint64(bits - 1)).astype(np.int64) for i in (1, 2, 3)]


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether all bits of a hash are set; true for every hash that was put in."""
    hit = np.ones(len(hashes), bool)
    for p in _places(hashes, len(words) * 64):
        hit &= (words[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return hit


def _counted(least: int, gram: int):
    """Minimisers of a batch, each once, with how many of its documents have it (2 for more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            value, start, _ = pieces(data, offsets, least, gram)
            doc = np.searchsorted(offsets, start, side="right")
            order = np.argsort(value, kind="stable")
            value, doc = value[order], doc[order]
            first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(value)] - 1 if len(value) else first
            several = (doc[last] != doc[first]).astype(np.int32) + 1
            yield pa.RecordBatch.from_arrays([pa.array(value[first].view(np.int64)), pa.array(several)], names=["h", "n"])

    return run


def bloom_filter(values: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of longs, of a size bounded whatever their number.

    A fuller filter lets more through to the exact steps behind it; it never loses one.
    """
    bits = 1 << 20
    values = values.toDF("v").persist()
    try:
        wanted = min(MOST_BITS, 16 * values.count())
        while bits < wanted:
            bits *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(bits // 64, np.uint64)
            for batch in batches:
                for p in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                    np.bitwise_or.at(words, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
            full = np.flatnonzero(words)
            for i in range(0, len(full), 100_000):
                part = full[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part].view(np.int64))], names=["at", "word"])

        found = values.mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    finally:
        values.unpersist()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return words


def _pieces_of(least: int, gram: int, words, what: str, hot):
    """Pieces of the rows ``key, id, text`` that pass a filter.  Those of ``hot`` minimisers
    are cut into their suffixes.

    ``hot``: these alone, each once a batch, by name.  ``names`` and ``texts``: those whose minimiser is in it, each once a batch, by name (a
    digest) or by text, with the least and the greatest id that has it.  ``places``: where
    those whose name is in it occur.
    """

    def smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches whose suffixes, should all be cut out, stay few."""
        for batch in batches:
            sizes = np.diff(utf8(batch.column(2))[1]).tolist()
            for a, b in in_chunks(sizes, BLOCK_BYTES):
                yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, split = xxhash.xxh64_intdigest, hot.value
        for batch in smaller(batches) if len(split) else batches:
            data, offsets = utf8(batch.column(2))
            key, ident = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            value, start, count = pieces(data, offsets, least, gram)
            if len(split):
                value, start, count, inside = split_hot(data, value, start, count, split, least)
            if what == "hot":
                value, start, count = value[inside], start[inside], count[inside]
            elif what != "places":
                hit = in_filter(words.value, value)
                value, start, count = value[hit], start[hit], count[hit]
            view = data.tobytes()
            ends = start + count + least - 1
            name = np.fromiter((digest(view[s:e]) for s, e in zip(start.tolist(), ends.tolist())), np.uint64, len(start))
            if what == "places":
                hit = in_filter(words.value, name)
                value, name, start, count = value[hit], name[hit], start[hit], count[hit]
                doc = np.searchsorted(offsets, start, side="right") - 1
                columns = [value.view(np.int64), name.view(np.int64), key[doc], ident[doc], start - offsets[doc], count - 1]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "name", "key", "id", "start", "n"])
                continue
            order = np.argsort(name, kind="stable")
            first = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]][: len(order)])
            if not len(first):
                continue
            one, ids = order[first], ident[np.searchsorted(offsets, start[order], side="right") - 1]
            texts = [view[s:e] for s, e in zip(start[one].tolist(), ends[one].tolist())] if what == "texts" else []
            columns = [
                pa.array(value[one].view(np.int64)),
                pa.array(texts, pa.binary()) if what == "texts" else pa.array(name[one].view(np.int64)),
                pa.array(np.minimum.reduceat(ids, first)),
                pa.array(np.maximum.reduceat(ids, first)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "piece", "low", "high"])

    return run


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows in lexicographic order; equal rows have equal ranks."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def first_owners(text: np.ndarray, offsets: np.ndarray, owner: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix of a block, the least owner of a suffix with the same first bytes.

    ``text`` holds the pieces end to end.  Suffixes are sorted by their first and last 8
    bytes; most differ in those.  Ties of several owners are resolved by the cover: their
    positions that fall on it are ranked by ``least - 6`` bytes, and two tied suffixes are
    equal if, at the shift that brings both to the cover, their ranks agree.  Every pair of
    residues has its shift.  Returns positions in ``text`` and owners.
    """
    counts = np.diff(offsets) - least + 1
    piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    at = (offsets[:-1] - np.cumsum(counts) + counts).astype(np.int32)[piece]
    at += np.arange(len(at), dtype=np.int32)
    word = np.lib.stride_tricks.sliding_window_view(text, 8)
    best = owner[piece]

    def words(places: np.ndarray) -> np.ndarray:
        return word[places].view(">u8")[:, 0]

    # Pairs of words that differ may share this key; equal ones always do.
    key = mix64(words(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words(at + (least - 8)))
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[heads, len(key)])
    del key
    own = best[order]
    several = np.minimum.reduceat(own, heads) < np.maximum.reduceat(own, heads)
    tied = np.sort(order[np.repeat(several, sizes)])
    del order, own
    if not len(tied):
        return at, best

    place = at[tied]
    ends = _ranks([words(place), words(place + (least - 8))])
    depth, on_cover = least - PERIOD + 1, np.isin(np.arange(PERIOD), COVER)
    sample = np.zeros(len(text), bool)
    shifts = []
    for shift in range(PERIOD):
        here = np.flatnonzero(on_cover[(place + shift) % PERIOD])
        sample[place[here] + shift] = True
        shifts.append(here)
    sample = np.flatnonzero(sample)
    rank = np.zeros(len(text), np.int32)
    rank[sample] = _ranks([words(sample + i) for i in [*range(0, depth - 8, 8), depth - 8]])
    own = best[tied]
    found = own.copy()
    for shift, here in enumerate(shifts):
        if not len(here):
            continue
        tie = ends[here] << 32 | rank[place[here] + shift]
        order = np.argsort(tie)
        heads = np.flatnonzero(np.r_[True, np.diff(tie[order]) != 0])
        first = np.minimum.reduceat(own[here[order]], heads)
        here = here[order]
        found[here] = np.minimum(found[here], np.repeat(first, np.diff(np.r_[heads, len(here)])))
    best[tied] = found
    return at, best


def _sorted_blocks(least: int):
    """Runs of suffixes that an earlier document has, from the pieces of buckets with
    several, sorted by bucket and text."""
    names = ["h", "name", "first", "last", "owner"]

    def merged(h, parts, low, high):
        """Equal pieces, which are neighbours, become one."""
        other = np.array([a != b for a, b in zip(parts[1:], parts)], bool)
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | other])
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        return h[first], [parts[i] for i in first], low, high

    def runs_of(h, parts, low, high) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        bucket = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
        shared = np.minimum.reduceat(low, starts) < np.maximum.reduceat(high, starts)
        shared &= np.diff(np.r_[starts, len(h)]) > 1
        mixed = np.flatnonzero(shared[bucket])
        if not len(mixed):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 5, names=names)
        offsets = np.r_[0, np.cumsum([len(parts[i]) for i in mixed])]
        text = np.frombuffer(b"".join(parts[i] for i in mixed), np.uint8)
        at, owner = first_owners(text, offsets, low[mixed], least)
        piece = np.searchsorted(offsets, at, side="right") - 1
        a = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])])
        b = np.r_[a[1:], len(at)] - 1
        keep = owner[a] < high[mixed][piece[a]]
        a, b = a[keep], b[keep]
        of = mixed[piece[a]]
        name = np.array([xxhash.xxh64_intdigest(parts[i]) for i in of], np.uint64).view(np.int64)
        columns = [h[of], name, at[a] - offsets[piece[a]], at[b] - offsets[piece[b]], owner[a]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = low = high = np.zeros(0, np.int64)
        parts: list[bytes] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in (0, 2, 3)]
            h, low, high = (np.concatenate(x) for x in zip((h, low, high), now))
            h, parts, low, high = merged(h, parts + batch.column(1).to_pylist(), low, high)
            # The last bucket may go on in the next batch.
            end = int(np.argmax(h == h[-1]))
            if end and sum(map(len, parts)) >= BLOCK_BYTES:
                yield runs_of(h[:end], parts[:end], low[:end], high[:end])
                h, parts, low, high = h[end:], parts[end:], low[end:], high[end:]
        if len(h):
            yield runs_of(h, parts, low, high)

    return run


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``key, spans``: per distinct id and text the ranges of bytes (start, end) covered by
    a string of ``least`` bytes that a document with a smaller id has too; written to the shared folder.

    Four readings of the texts keep what moves small.  Minimisers are counted; pieces whose
    minimiser may repeat are summed up by name; those of buckets with several pieces travel
    with their text and are sorted (a piece alone in its bucket belongs to the first
    document that has it); last, the places of pieces with an earlier owner are looked up.
    Buckets of more than ``HOT_PIECES`` pieces cost a fifth reading: their strings are dealt
    out one by one, by hash, and need no text unless two hashes are equal.
    """
    if gram < 8 or least < gram + PERIOD:
        raise ValueError("grams have 8 bytes or more, and strings at least 7 more than grams")
    rows = docs.select(
        F.xxhash64(id_col, text_or_empty(text_col)).alias("key"),
        F.coalesce(F.col(id_col).try_cast("bigint"), F.lit(LAST_ID)).alias("id"),
        text_or_empty(text_col).alias("text"),
    ).filter(F.octet_length("text") >= least)
    spark, paths, sent = docs.sparkSession, [], []

    def send(value: np.ndarray):
        sent.append(spark.sparkContext.broadcast(value))
        return sent[-1]

    def settle(df: DataFrame, purpose: str) -> DataFrame:
        """Stored; what the tasks needed for it is dropped, also shuffles that nothing reads any more."""
        out, path = stored_at(df, purpose)
        paths.append(path)
        release(spark)
        return out

    counts = rows.select("text").mapInArrow(_counted(least, gram), "h bigint, n int")
    repeated = send(bloom_filter(counts.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")))
    release(spark)

    kind = "h bigint, piece bigint, low bigint, high bigint"

    def summed(named: DataFrame, purpose: str) -> DataFrame:
        buckets = named.groupBy("h").agg(
            F.min("piece").alias("a"), F.max("piece").alias("b"), F.min("low").alias("low"),
            F.max("high").alias("high"), F.count(F.lit(1)).alias("n"),
        )
        return settle(buckets.filter("low < high"), purpose)

    none = send(np.zeros(0, np.uint64))
    buckets = summed(rows.mapInArrow(_pieces_of(least, gram, repeated, "names", none), kind), "buckets")
    repeated.destroy()
    large = buckets.filter((F.col("n") > HOT_PIECES) & (F.col("a") != F.col("b")))
    large = large.select("h").toArrow().column("h").to_numpy()
    hot = send(np.sort(large.view(np.uint64)))
    if len(large):
        # Equal strings share their hash: a bucket now holds one string, seldom two.
        cut = summed(rows.mapInArrow(_pieces_of(least, gram, none, "hot", hot), kind), "cut-buckets")
        buckets = buckets.filter((F.col("n") <= HOT_PIECES) | (F.col("a") == F.col("b"))).unionByName(cut)
    whole = F.lit(-1).cast("bigint")
    alone = buckets.filter("a = b").select(
        "h", F.col("a").alias("name"), F.lit(0).cast("bigint").alias("first"), whole.alias("last"), F.col("low").alias("owner")
    )
    several = send(bloom_filter(buckets.filter("a <> b").select("h")))
    texts = rows.mapInArrow(_pieces_of(least, gram, several, "texts", hot), "h bigint, piece binary, low bigint, high bigint")
    texts = texts.repartition("h").sortWithinPartitions("h", "piece")
    runs = texts.mapInArrow(_sorted_blocks(least), "h bigint, name bigint, first bigint, last bigint, owner bigint")
    runs = settle(alone.unionByName(runs), "runs")
    several.destroy()

    owned = send(bloom_filter(runs.select("name")))
    places = rows.mapInArrow(
        _pieces_of(least, gram, owned, "places", hot), "h bigint, name bigint, key bigint, id bigint, start bigint, n bigint"
    )
    found = places.join(runs, ["h", "name"]).filter("owner < id")
    last = F.when(F.col("last") < 0, F.col("n")).otherwise(F.col("last"))
    span = F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + last + least).alias("b"))
    found = stored(found.groupBy("key").agg(F.collect_list(span).alias("spans")), "spans")
    for value in (none, hot, owned):
        value.destroy()
    for path in paths:
        remove(spark, path)
    release(spark)
    return found


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)]))


def _split(docs: DataFrame, id_col: str, text_col: str, least: int, gram: int) -> tuple[DataFrame, DataFrame, str]:
    """The rows that may lose bytes, with a column of spans (null for none), and the others,
    whose texts stay where they are."""
    key, spans, own = fresh(docs, "text_key", "spans", "own_key")
    found = repeated_spans(docs, id_col, text_col, least, gram)
    words = docs.sparkSession.sparkContext.broadcast(bloom_filter(found.select("key")))
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), text_or_empty(text_col)))
    at = len(docs.columns)

    def those(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                inside = in_filter(words.value, batch.column(at).to_numpy().view(np.uint64))
                yield batch.filter(pa.array(inside == hit))

        return run

    found = found.select(F.col("key").alias(own), F.col("spans").alias(spans))
    touched = keyed.mapInArrow(those(True), keyed.schema)
    touched = touched.join(found, F.col(key) == F.col(own), "left").drop(key, own)
    return touched, keyed.mapInArrow(those(False), keyed.schema).drop(key), spans


def repeated_text(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM
) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    A text is its UTF-8 bytes.  A byte is removed if it is covered by a string of ``least``
    bytes that also starts in a document with a smaller id; strings lie within one text and
    are judged on the input.  Rows with the same id do not count against each other.  Null
    and empty texts have no bytes; ids are whole numbers, and a null id, or one that is no
    number, comes after all others.  Repeated rows stay
    repeated; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    touched, others, spans = _split(rows, "id", "text", least, gram)
    data, zero = text_or_empty("text").cast("binary"), F.lit(0).cast("bigint")
    others = others.select(
        "id", F.octet_length(data).cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2(data, 256).alias("kept_sha256"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, union = text.encode("utf-8", "surrogatepass"), _union(found or [])
                digest = hashlib.sha256(kept_bytes(data, union)).hexdigest()
                out.append((len(data), sum(b - a for a, b in union), len(union), digest))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    judged = touched.select("id", text_or_empty("text"), spans).mapInArrow(
        run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
    return judged.unionByName(others).withColumnRenamed("id", id_col)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM
) -> DataFrame:
    """The rows of ``docs`` with the repeated bytes cut out of their text, other columns as
    they are.  Where a cut goes through a character its other bytes go too."""
    touched, others, spans = _split(docs, id_col, text_col, least, gram)
    names, at, of = docs.columns, touched.columns.index(text_col), touched.columns.index(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, found in enumerate(batch.column(of).to_pylist()):
                if found:
                    kept = kept_bytes(texts[i].encode("utf-8", "surrogatepass"), _union(found))
                    texts[i] = kept.decode("utf-8", "ignore")
            columns = [c for i, c in enumerate(batch.columns) if i != of]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return touched.mapInArrow(run, docs.schema).unionByName(others)
