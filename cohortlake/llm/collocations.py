"""Phrases that occur more often than their parts suggest, by dynamic itemset counting.

The texts are dealt out to shards that are scanned in a cycle.  Words are counted from the
first scan on; a longer phrase as soon as both its subphrases (all but the last word, all
but the first) have reached the threshold, whatever the scan, so several lengths are counted
in one scan.  Every phrase is counted for one full cycle, in whichever shard that begins,
and then has its exact count.  Scans end when no phrase is being counted any more.

What phrases have reached the threshold in a scan goes to the tasks of the later ones as a
Bloom filter.  The filters alone decide in which scans a phrase is counted, so a phrase that
one lets through by mistake is counted for one full cycle too, and is found to be rare.

Most phrases that are counted are rare, so the scans count by a digest of 64 bits, which can
only add up too much.  What the filters hold in the end is counted by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import in_chunks, mix64, release, remove, stored, stored_at, text_or_empty, utf8, work_path
from cohortlake.llm.decontaminate import when_small
from cohortlake.llm.suffix_dedup import bloom_filter, in_filter

LEAST, LONGEST, SHARDS = 100, 5, 3
NO_LANG = "und"
# Bytes of text worked on at a time.
CHUNK_BYTES = 1 << 21
# Kinds of bytes: of a word, between words, between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts that lie end to end: their bytes, the piece that each is in
    (numbered through) and its text."""
    kind = _KIND[data]
    inside = kind == 0
    begins_text = np.zeros(len(data) + 1, bool)
    begins_text[offsets[:-1]] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]][: len(data)] | begins_text[:-1]))
    # Bytes of words up to any place, so that words lie end to end without what is between them.
    before = np.cumsum(inside) - inside
    breaks = np.cumsum((kind == 2) | begins_text[:-1])
    kept = _LOWER[data[inside]]
    ends = np.r_[before[starts], len(kept)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return words, breaks[starts], np.searchsorted(offsets, starts, side="right") - 1


def spaced(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words with a space after each, and where each begins (and the end of all)."""
    _, ends, data = words.buffers()
    ends, data = np.frombuffer(ends, np.int64), np.frombuffer(data, np.uint8)
    sizes = np.diff(ends)
    out = np.full(len(data) + len(sizes), 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
    return out, ends + np.arange(len(ends))


def _phrases(text: np.ndarray, begins: np.ndarray, at: np.ndarray, length: int) -> pa.Array:
    """The phrases of some words' length that begin with the words ``at``."""
    start, sizes = begins[at], begins[at + length] - 1 - begins[at]
    past = np.cumsum(sizes)
    data = text[np.repeat(start - (past - sizes), sizes) + np.arange(sizes.sum())]
    ends = np.r_[0, past].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _numbered(values) -> tuple[np.ndarray, np.ndarray]:
    """For every value its number among the distinct ones, and where each first occurs."""
    codes = pc.dictionary_encode(values).indices.to_numpy().astype(np.int64)
    first = np.empty(int(codes.max(initial=-1)) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]  # the last one written stays
    return codes, first


def _hashes(parts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(p) for p in parts], np.uint64)


def _digests(lang: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Digests of phrases from the hashes of their language and of their words (a row each)."""
    out = mix64(lang + np.uint64(1))
    for word in words.T:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out


def _digests_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of rows ``lang, phrase``."""
    for batch in batches:
        langs, phrases = (batch.column(i).cast(pa.binary()).to_pylist() for i in (0, 1))
        out, lang = np.zeros(len(phrases), np.uint64), _hashes(langs)
        split = [p.split(b" ") for p in phrases]
        length = np.array([len(s) for s in split], np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            words = _hashes([w for i in own for w in split[i]]).reshape(-1, n)
            out[own] = _digests(lang[own], words)
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["v"])


def _reached(filters: list[np.ndarray], digests: np.ndarray, since: np.ndarray) -> np.ndarray:
    """The scan in which a phrase reached the threshold; one after the last for not yet.

    Only scans after ``since`` count, those in which the phrase was counted.  An earlier filter
    may let it through by mistake; longer phrases would then count from a scan on in which
    their subphrases were not looked at, and lose part of their cycle."""
    out = np.full(len(digests), len(filters) + 1, np.int64)
    for scan in range(len(filters), 0, -1):
        out[in_filter(filters[scan - 1], digests) & (since < scan)] = scan
    return out


class _Chunk:
    """Texts as numbered words, and the phrases of one length, numbered by language.

    ``code`` has the phrase at each place ``at`` that is left, ``first`` where each phrase
    occurs first, ``since`` the scan in which the later of its subphrases reached the
    threshold."""

    def __init__(self, langs: list[bytes], data: np.ndarray, offsets: np.ndarray, filters: list[np.ndarray]):
        self.words, self.piece, self.text_of = words_of(data, offsets)
        self.filters, self.length = filters, 1
        if not len(self.words):
            return
        self.lang_names, lang_of = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = lang_of[self.text_of]
        word, seen = _numbered(self.words)
        self.lang_hash = _hashes(self.lang_names.tolist())
        self.spaced, self.begins = spaced(self.words)
        view = self.spaced.tobytes()
        ends = zip(self.begins[seen].tolist(), (self.begins[seen + 1] - 1).tolist())
        self.word_hash = _hashes([view[a:b] for a, b in ends])[word]
        self.code, self.first = _numbered(pa.array(word * len(self.lang_names) + self.lang))
        self.at, self.since = np.arange(len(word)), np.zeros(len(self.first), np.int64)
        self._digests = None

    def digests(self) -> np.ndarray:
        """The digest of each phrase."""
        if self._digests is None:
            place = self.at[self.first]
            words = self.word_hash[place[:, None] + np.arange(self.length)]
            self._digests = _digests(self.lang_hash[self.lang[place]], words)
        return self._digests

    def reached(self) -> np.ndarray:
        """The scan in which each phrase reached the threshold."""
        return _reached(self.filters, self.digests(), self.since)

    def named(self, which: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Language, text and count of some of the phrases."""
        place = self.at[self.first[which]]
        phrases = _phrases(self.spaced, self.begins, place, self.length)
        return self.lang_names[self.lang[place]], phrases, np.bincount(self.code)[which]

    def totals(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Rows of an empty phrase, which count all words of each language."""
        total = np.bincount(self.lang, minlength=len(self.lang_names))
        return self.lang_names, pa.array([b""] * len(total), pa.large_binary()), total

    def lengthen(self) -> bool:
        """Go on to the phrases that are a word longer and whose subphrases have both
        reached the threshold; false if there is none.  They are numbered by those of both."""
        when, at = self.reached(), self.at
        good = when[self.code] <= len(self.filters)
        follows = good[:-1] & good[1:] & (at[1:] == at[:-1] + 1) & (self.piece[at[1:]] == self.piece[at[:-1]])
        follows = np.flatnonzero(follows)
        left, right, self.at = self.code[follows], self.code[follows + 1], at[follows]
        self.code, self.first = _numbered(pa.array(left * len(when) + right))
        self.since = np.maximum(when[left[self.first]], when[right[self.first]])
        self.length += 1
        self._digests = None
        return len(follows) > 0


def _chunks(batches: Iterator[pa.RecordBatch], filters: list[np.ndarray]) -> Iterator[_Chunk]:
    for batch in batches:
        langs = [x.encode("utf-8", "surrogatepass") for x in batch.column(0).to_pylist()]
        data, offsets = utf8(batch.column(1))
        for a, b in in_chunks(np.diff(offsets).tolist(), CHUNK_BYTES):
            chunk = _Chunk(langs[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], filters)
            if len(chunk.words):
                yield chunk


def _named_batch(own: np.ndarray, phrases: pa.Array, length: int | None, n: np.ndarray) -> pa.RecordBatch:
    columns = {
        "lang": pa.array(own, pa.binary()).cast(pa.string()),
        "phrase": phrases.cast(pa.large_string()).cast(pa.string()),
        "length": pa.array(np.full(len(n), length, np.int32)),
        "n": pa.array(n.astype(np.int64)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _scan(filters, now: int, shards: int, longest: int, named: bool = True):
    """Counts of the phrases that are counted in scan ``now`` (from 1), by language.

    ``filters`` holds, for each scan before, the digests of phrases that reached the
    threshold in it.  A phrase is counted from the scan after the one in which the later of
    its subphrases reached it, for one cycle.  Rows of an empty phrase count all words.

    Not ``named``, phrases are ``digest, since, length, n``, and there are no rows of an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, filters.value):
            if named and now <= shards:
                own, phrases, n = chunk.totals()
                yield _named_batch(own, phrases, 0, n)
            while True:
                active = np.flatnonzero((chunk.since < now) & (now <= chunk.since + shards))
                if len(active) and named:
                    own, phrases, n = chunk.named(active)
                    yield _named_batch(own, phrases, chunk.length, n)
                elif len(active):
                    columns = [
                        pa.array(chunk.digests()[active].view(np.int64)),
                        pa.array(chunk.since[active].astype(np.int32)),
                        pa.array(np.full(len(active), chunk.length, np.int32)),
                        pa.array(np.bincount(chunk.code)[active].astype(np.int64)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["digest", "since", "length", "n"])
                if chunk.length == longest or now == 1 or not chunk.lengthen():
                    break

    return run


def _named(filters, longest: int):
    """Counts by name of the phrases of two words or more that have reached the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, filters.value):
            while chunk.length < longest and chunk.lengthen():
                which = np.flatnonzero(chunk.reached() <= len(filters.value))
                if len(which):
                    own, phrases, n = chunk.named(which)
                    yield _named_batch(own, phrases, chunk.length, n)

    return run


def _trim(filters, shards: int):
    """Texts without what no later scan counts, after the words have had their cycle.

    Two neighbours stay together if the pair of them is still being counted or has reached
    the threshold; no longer phrase over another pair can.  Elsewhere the text is cut, and
    words without a neighbour go.

    As these are lost, all words that have reached the threshold follow by name with their
    count ``n`` (null for texts), and the count of all words by an empty name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, filters.value):
            live = np.zeros(len(chunk.words), bool)
            counted = [chunk.totals(), chunk.named(np.flatnonzero(chunk.reached() <= len(filters.value)))]
            if chunk.lengthen():
                pairs = (chunk.since + shards > len(filters.value)) | (chunk.reached() <= len(filters.value))
                live[chunk.at] = pairs[chunk.code]
            text = chunk.spaced
            text[chunk.begins[1:][~live] - 1] = 0x0A
            kept = np.flatnonzero(live | np.r_[False, live[:-1]])
            sizes = chunk.begins[kept + 1] - chunk.begins[kept]
            past = np.cumsum(sizes)
            data = text[np.repeat(chunk.begins[kept] - (past - sizes), sizes) + np.arange(sizes.sum())]
            heads = np.flatnonzero(np.r_[True, np.diff(chunk.text_of[kept]) != 0][: len(kept)])
            ends = np.r_[0, past][np.r_[heads, len(kept)]].astype(np.int64)
            texts = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            langs = pa.array(chunk.lang_names[chunk.lang[kept[heads]]], pa.binary())
            columns = [langs.cast(pa.string()), texts.cast(pa.large_string()).cast(pa.string()), pa.nulls(len(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "text", "n"])
            for own, words, n in counted:
                batch = _named_batch(own, words, 1, n)
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1, 3)], names=["lang", "text", "n"])

    return run


def _sharded(docs: DataFrame, text_col: str, lang_col: str | None, shards: int) -> tuple[list[DataFrame], str]:
    """The texts, dealt out in turn to shards in the shared folder, and where."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)) if lang_col else F.lit(NO_LANG)
    rows = docs.select(
        lang.alias("lang"), text_or_empty(text_col).alias("text"), (F.monotonically_increasing_id() % shards).alias("shard")
    )
    spark, path = docs.sparkSession, work_path(docs.sparkSession, "shards")
    rows.write.partitionBy("shard").parquet(path)
    found = spark.read.schema("lang string, text string, shard int").parquet(path)
    return [found.filter(F.col("shard") == i).select("lang", "text") for i in range(shards)], path


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", least: int = LEAST,
    longest: int = LONGEST, shards: int = SHARDS,
) -> DataFrame:
    """``lang, phrase, length, n``: every phrase of up to ``longest`` words that occurs at
    least ``least`` times in the texts of a language, with its exact count; and for each
    language a row with an empty phrase of length 0, the count of all its words.

    Words are runs of bytes other than space and tab, A-Z lower-cased, within pieces cut at
    ``.,;:!?`` and line breaks; phrases do not reach over pieces, and their occurrences may
    overlap.  Null and empty texts have no words; texts without a language are ``und``.
    Repeated rows count each.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts, used = _sharded(docs, text_col, lang_col, shards)
    kind = "digest bigint, since int, length int, n bigint"
    filters: list[np.ndarray] = []
    counting, of_scan, used, words = None, None, [used], None
    last_reached, now = 0, 0

    def trimmed() -> tuple[list[DataFrame], list[DataFrame]]:
        """The shards without what no later scan counts, and the counts of their words."""
        sent = spark.sparkContext.broadcast(filters)
        small = [stored_at(p.mapInArrow(_trim(sent, shards), "lang string, text string, n bigint"), "trimmed") for p in parts]
        used.extend(path for _, path in small)
        sent.destroy()
        found = [p.filter("n is not null").select("lang", F.col("text").alias("phrase"), "n") for p, _ in small]
        return [p.filter("n is null").select("lang", "text") for p, _ in small], found

    while now < shards or now < last_reached + shards:
        now += 1
        sent = spark.sparkContext.broadcast(filters)
        # ``had``: the count before this scan.  Phrases of one digest that are counted in other
        # scans, or have other lengths, stay apart; the others' counts can only be too great.
        both = parts[(now - 1) % shards].mapInArrow(_scan(sent, now, shards, longest, named=False), kind)
        both = both.withColumn("had", F.lit(0).cast("bigint"))
        if counting is not None:
            both = both.unionByName(counting)
        state, path = stored_at(
            both.groupBy("digest", "since", "length").agg(F.sum("n").alias("n"), F.sum("had").alias("had")), "scan"
        )
        sent.destroy()
        # The few that have reached the threshold in this scan, once out of all.
        hits, path_of_hits = stored_at(state.filter((F.col("n") >= least) & (F.col("had") < least)).select("digest", "length"), "hits")
        used.append(path_of_hits)
        filters.append(bloom_filter(hits.select("digest")))
        if not hits.filter(F.col("length") < longest).isEmpty():
            last_reached = now
        counting = state.filter(F.col("since") + shards > now).withColumn("had", F.col("n"))
        if of_scan:
            remove(spark, of_scan)
        of_scan = path
        if now == 2 * shards:
            parts, words = trimmed()
        release(spark)
    if words is None:
        parts, words = trimmed()
    sent = spark.sparkContext.broadcast(filters)
    found = None
    for part, own in zip(parts, words):
        more = part.mapInArrow(_named(sent, longest), "lang string, phrase string, length int, n bigint")
        more = more.unionByName(own.withColumn("length", F.when(F.col("phrase") == "", 0).otherwise(1)))
        found = more if found is None else found.unionByName(more)
    found = found.groupBy("lang", "phrase").agg(F.max("length").alias("length"), F.sum("n").alias("n"))
    found = stored(found.filter((F.col("n") >= least) | (F.col("length") == 0) & (F.col("n") > 0)), "phrases")
    sent.destroy()
    for path in [*used, of_scan]:
        remove(spark, path)
    return found


def _part(words, first, size):
    return F.array_join(F.slice(words, first, size), " ")


def scored_phrases(found: DataFrame, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of each language, from
    the output of ``frequent_phrases``.

    A phrase of count a, cut after its first words into parts of counts l and r, scores
    floor(1000 * a * n / (l * r)); the cut with the lowest score counts, of equal ones the
    first.  Phrases that lie in a longer one with the same count are left out.  Products
    are decimals of 38 digits; beyond, the query fails instead of giving wrong numbers.
    """
    total = found.filter("length = 0").select("lang", F.col("n").alias("total"))
    phrases = found.filter("length > 0").select("lang", "phrase", "length", "n")
    longer = found.filter("length > 1").select("lang", "phrase", "length", "n", F.split("phrase", " ").alias("w"))
    counts = phrases.select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), F.col("n").alias("part_n"))

    cuts = longer.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    for name, part in (("l", _part("w", F.lit(1), F.col("k"))), ("r", _part("w", F.col("k") + 1, F.size("w")))):
        cuts = cuts.withColumn(f"{name}_part", part)
        cuts = cuts.join(counts, (F.col("lang") == F.col("part_lang")) & (F.col(f"{name}_part") == F.col("part")))
        cuts = cuts.withColumnRenamed("part_n", name).drop("part", "part_lang", f"{name}_part")
    cuts = cuts.join(when_small(total), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.withColumn("top", (wide("a") * wide("total")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"))
    scored = scored.withColumn("bottom", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", F.col("total").alias("n"))).alias("best")
    )

    # Shorter phrases inside a longer one, with the greatest count of such a longer one.
    inside = longer.filter("length > 2").select(
        "lang", "n", "w", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size")
    )
    inside = inside.select(
        "lang", "n", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at")
    )
    inside = inside.select("lang", _part("w", F.col("at"), F.col("size")).alias("phrase"), "n")
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter("around is null or around < best.a")
    # The best of each of some parts of a language first, so that no task sees all of one.
    kept = kept.withColumn("part", F.pmod(F.hash("phrase"), F.lit(64)))
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("best.score"), F.desc("best.a"), "phrase")
        kept = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return kept.select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "best.a", "best.l", "best.r", "best.n", "best.score"
    )


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", least: int = LEAST,
    longest: int = LONGEST, top: int = 2000, shards: int = SHARDS,
) -> DataFrame:
    """The ``top`` phrases of every language: ``frequent_phrases``, scored by ``scored_phrases``.

    Nulls, empty texts, repeated rows and empty tables are as there; equal scores are
    ordered by count, then by the bytes of the phrase.  Other columns are not read."""
    found = frequent_phrases(docs, text_col, lang_col, least, longest, shards)
    return scored_phrases(found, top)
