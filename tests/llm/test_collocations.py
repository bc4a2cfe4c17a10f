"""Dynamic itemset counting against counting all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortlake.llm import collocations as co
from cohortlake.llm.queries import QUERIES

SCHEMA = "lang string, text string, doc_id bigint, n bigint, phrase string, length int"


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", piece) for piece in re.split("[.,;:!?\x0a-\x0d]", text)]


def brute_counts(rows, longest):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        for piece in words(text):
            total[lang or "und" if lang is None else lang] += len(piece)
            for k in range(1, longest + 1):
                for i in range(len(piece) - k + 1):
                    counts["und" if lang is None else lang, " ".join(piece[i : i + k])] += 1
    return counts, total


def brute(rows, least, longest, top):
    counts, total = brute_counts(rows, longest)
    counts = {key: n for key, n in counts.items() if n >= least}
    out = []
    for (lang, phrase), a in counts.items():
        w = phrase.split(" ")
        if len(w) < 2:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        longer = [
            n for (other, q), n in counts.items()
            if other == lang and len(q.split(" ")) > len(w) and f" {phrase} " in f" {q} "
        ]
        if not any(n >= a for n in longer):
            out.append((lang, phrase, a, left, right, total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(ranked)


def some_rows(rng, n, vocabulary=6, langs=("en", "de", None, "")):
    letters = ["a", "B", "ü", "dd", "É", "x\x00y", "日本", "it's", "-", "q"][:vocabulary]
    gaps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", " ! ", "?"]
    for _ in range(n):
        text = "".join(rng.choice(letters) + rng.choice(gaps) for _ in range(rng.randrange(0, 40)))
        yield rng.choice(langs), text


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, 1, 2, "x", 3) for lang, text in rows], SCHEMA)


@pytest.mark.parametrize("shards,least", [(1, 3), (3, 5), (4, 12)])
def test_against_all_phrases(spark, shards, least):
    rng = random.Random(shards)
    rows = [*some_rows(rng, 80), ("en", None), (None, None), ("en", ""), ("fr", "  \t")] + [("en", "one two three four five six")] * 30
    docs = frame(spark, rows).repartition(3)
    found = co.frequent_phrases(docs, least=least, shards=shards)
    counts, total = brute_counts(rows, 5)
    want = {(*key, n) for key, n in counts.items() if n >= least} | {(lang, "", n) for lang, n in total.items() if n}
    assert {(r.lang, r.phrase, r.n) for r in found.collect()} == want
    got = sorted(tuple(r) for r in co.scored_phrases(found, top=7).collect())
    assert got == brute(rows, least, 5, 7)


def test_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [*some_rows(rng, 400, 10)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_phrases"](spark, str(tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in got.dtypes} == {"string", "bigint"}
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 100, 5, 2000)


def test_empty_table(spark):
    assert co.collocations(frame(spark, [])).collect() == []


class Sent:
    def __init__(self, value):
        self.value = value


def test_filters_that_let_through_too_much(monkeypatch):
    """Phrases counted by mistake get one cycle too, and the counts of all others stay exact:
    the scans of ``frequent_phrases``, run here, with filters that are wrong for every third."""
    names: dict[int, set] = {}

    def wrong(filter_of, digests):
        scan = int(filter_of[0])
        return np.array([int(d) in names[scan] or int(d) % 3 == 0 and bool(names[scan]) for d in digests], bool)

    monkeypatch.setattr(co, "in_filter", wrong)
    rows = [("en", text) for _, text in some_rows(random.Random(4), 120)]
    shards, least, now, last = 3, 9, 0, 0
    counts, scans = Counter(), {}
    filters = []
    while now < shards or now < last + shards:
        now += 1
        part = rows[(now - 1) % shards :: shards]
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part])], names=["lang", "text"])
        before = Counter(counts)
        for out in co._scan(Sent(list(filters)), now, shards, 5)(iter([batch])):
            for lang, phrase, length, n in zip(*(c.to_pylist() for c in out.columns)):
                counts[lang, phrase] += n
                scans.setdefault((lang, phrase), set()).add(now)
        new = [k for k, n in counts.items() if n >= least > before[k] and k[1] and k[1].count(" ") < 4]
        names[now] = set()
        if new:
            last = now
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in new]), pa.array([k[1] for k in new])], names=["a", "b"])
            names[now] = {int(v) & (1 << 64) - 1 for v in next(co._digests_of(iter([batch]))).column(0).to_pylist()}
        filters.append(np.array([now]))
    want, _ = brute_counts(rows, 5)
    counted = {k: n for k, n in counts.items() if k[1]}
    assert all(n == want[k] for k, n in counted.items())
    assert {k for k, n in counted.items() if n >= least} == {k for k, n in want.items() if n >= least}
    assert any(n < least and k[1].count(" ") for k, n in counted.items())
    assert all(max(s) - min(s) < shards for s in scans.values())


def test_lengths_are_interleaved():
    """Longer phrases are counted before shorter ones have had their whole cycle."""
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["a b c " * 5])], names=["lang", "text"])
    digests = [("en", p) for p in ("a", "b", "c", "a b", "b c")]
    rows = pa.RecordBatch.from_arrays([pa.array([d[0] for d in digests]), pa.array([d[1] for d in digests])], names=["a", "b"])
    known = np.array(next(co._digests_of(iter([rows]))).column(0).to_pylist(), np.int64).view(np.uint64)
    words_, pairs = (np.zeros(1 << 14, np.uint64) for _ in range(2))
    from cohortlake.llm.suffix_dedup import _places

    for target, own in ((words_, known[:3]), (pairs, known[3:])):
        for p in _places(own, len(target) * 64):
            np.bitwise_or.at(target, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
    out = co._scan(Sent([words_, pairs]), 3, 4, 5)(iter([batch]))
    lengths = {length for r in out for length in r.column(2).to_pylist()}
    assert lengths == {0, 1, 2, 3}


def test_trimmed_texts_keep_what_later_scans_count():
    """After the words' cycle a pair stays if it has reached the threshold or is being counted."""
    from cohortlake.llm.suffix_dedup import _places

    def filter_of(*phrases):
        rows = pa.RecordBatch.from_arrays([pa.array(["en"] * len(phrases)), pa.array(phrases)], names=["a", "b"])
        words_ = np.zeros(1 << 14, np.uint64)
        if phrases:
            known = np.array(next(co._digests_of(iter([rows]))).column(0).to_pylist(), np.int64).view(np.uint64)
            for p in _places(known, len(words_) * 64):
                np.bitwise_or.at(words_, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
        return words_

    # Two shards, four scans: "late" has reached the threshold in the third.
    filters = [filter_of("a", "b", "c"), filter_of("a b"), filter_of("late"), filter_of()]
    texts = ["A b x a b late c a", "c a. b", "x", "", "b late. a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(texts)], names=["lang", "text"])
    out = next(co._trim(Sent(filters), 2)(iter([batch])))
    assert out.column(1).to_pylist() == ["a b\na b late c\n", "b late\na b\n"]
    # Trimmed again they stay as they are.
    assert next(co._trim(Sent(filters), 2)(iter([out]))).column(1).to_pylist() == out.column(1).to_pylist()


def test_a_pair_let_through_before_its_words_does_not_shorten_the_cycle_of_longer_ones(monkeypatch):
    """An early filter has "a b" by mistake, while "a" gets there in the third scan: "a b" can get
    there in the fourth at the earliest, and "a b c" is counted for the three scans after."""
    got_there = {1: ["b", "c", "a b"], 2: ["b c"], 3: ["a"], 4: ["a b"], 5: [], 6: [], 7: [], 8: []}

    def digests(phrases):
        rows = pa.RecordBatch.from_arrays([pa.array(["en"] * len(phrases), pa.string()), pa.array(phrases, pa.string())], names=["a", "b"])
        return {int(v) & (1 << 64) - 1 for v in next(co._digests_of(iter([rows]))).column(0).to_pylist()}

    names = {scan: digests(phrases) for scan, phrases in got_there.items()}
    monkeypatch.setattr(co, "in_filter", lambda f, d: np.array([int(x) in names[int(f[0])] for x in d], bool))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["a b c"])], names=["lang", "text"])
    counted = {}
    for now in range(1, 9):
        filters = [np.array([scan]) for scan in range(1, now)]
        for out in co._scan(Sent(filters), now, 3, 5)(iter([batch])):
            for phrase in out.column(1).to_pylist():
                counted.setdefault(phrase, []).append(now)
    assert counted["a b"] == [4, 5, 6]
    assert counted["a b c"] == [5, 6, 7]


def test_scans_count_by_digest_and_the_end_by_name():
    """What the scans move has no texts; the words' counts come with the trimmed texts, those of
    longer phrases from these."""
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["a b c. " * 5 + "a x"])], names=["lang", "text"])
    once = np.array([(1 << 64) - 1] * 64, np.uint64)  # lets everything through
    scan = lambda named: list(co._scan(Sent([once]), 2, 2, 3, named=named)(iter([batch])))
    plain = scan(False)
    assert all(pa.types.is_integer(f.type) for out in plain for f in out.schema)
    by_name = [dict(zip(out.schema.names, row)) for out in scan(True) for row in zip(*(c.to_pylist() for c in out.columns))]
    got = sorted((row["length"], row["n"]) for out in plain for row in out.to_pylist())
    assert got == sorted((r["length"], r["n"]) for r in by_name if r["length"])
    assert len({row["digest"] for out in plain for row in out.to_pylist()}) == len(got)

    filters = [once, once]
    out = list(co._trim(Sent(filters), 1)(iter([batch])))
    texts = [r for o in out for r in o.to_pylist() if r["n"] is None]
    words_ = {r["text"]: r["n"] for o in out for r in o.to_pylist() if r["n"] is not None}
    assert words_ == {"": 17, "a": 6, "b": 5, "c": 5, "x": 1}
    again = pa.RecordBatch.from_arrays([pa.array([t["lang"] for t in texts]), pa.array([t["text"] for t in texts])], names=["lang", "text"])
    named = {r["phrase"]: r["n"] for o in co._named(Sent(filters), 2)(iter([again])) for r in o.to_pylist()}
    assert named == {"a b": 5, "b c": 5, "a x": 1}
