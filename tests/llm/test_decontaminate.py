from __future__ import annotations

import itertools
import math
import random
import re

import corpus_pipeline
from cohortlake.llm import decontaminate as dc
from cohortlake.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, item_id string"


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, window=13, share=0.8, least=5, every=False):
    """Every document on every text at every shift; ``every`` asks for no mask to agree."""
    of = {}
    for i, t in items:
        w = tuple(words_of(t))
        if len(w) >= least:
            of[w] = min(i, of.get(w, i))
    out = set()
    shortest = min(map(len, dc.MASKS))
    for d, t in docs:
        dw = words_of(t)
        for iw, item in of.items():
            masks = [*dc.MASKS, *({"1" * len(iw)} if len(iw) < shortest else ())]
            n, best = min(window, len(iw)), None
            for shift in range(-len(iw) + 1, len(dw)):
                pairs = [(j, iw[j] == dw[j + shift]) for j in range(len(iw)) if 0 <= j + shift < len(dw)]
                eq = [e for _, e in pairs]
                if len(pairs) < n or not (every or any(
                    all(eq[s + k] for k, bit in enumerate(m) if bit == "1") for m in masks for s in range(len(eq) - len(m) + 1)
                )):
                    continue
                for s in range(len(pairs) - n + 1):
                    k = sum(eq[s : s + n])
                    now = (-k, pairs[s][0] + shift, pairs[s][0])
                    if k >= math.ceil(share * n - 1e-9) and (best is None or now < best):
                        best = now
            if best:
                out.add((d, item, best[1], best[2], n, -best[0]))
    return out


def test_masks_hit_every_window_with_two_differences():
    for a, b in itertools.combinations(range(dc.WINDOW), 2):
        assert any(
            bit_ok for m in dc.MASKS for s in range(dc.WINDOW - len(m) + 1)
            for bit_ok in [all(s + k not in (a, b) for k, bit in enumerate(m) if bit == "1")]
        )


def make(rng):
    vocabulary = [f"w{i}" for i in range(12)] + ["the", "É", "of"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randrange(3, 30))) for i in range(14)]
    items += [(50, items[3][1].upper() + "!"), (51, None), (52, ""), (53, "one two three"), (54, "s1 s2 s3 s4 s5"), (55, "q1 q2 q3 q4 q5 q6 q7")]
    docs = []
    for d in range(60):
        words = text(rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(3)):
            item = words_of(rng.choice(items)[1])
            item = item[rng.randrange(2) * rng.randrange(5) :]
            for _ in range(rng.randrange(5)):
                if item:
                    item[rng.randrange(len(item))] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((d, rng.choice([" ", ", ", "_\n"]).join(words)))
    docs += [(100, None), (101, ""), (102, "s1 s2 s3 s4 s5"), (102, "S1-s2 s3 s4 s5"), (3, docs[3][1]), (None, items[5][1]),
             (103, items[3][1] + " x " * 20000 + items[3][1])]
    return docs, items


def test_against_all_shifts(spark):
    docs, items = make(random.Random(5))
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    got = {(r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_window, r.n_equal) for r in dc.benchmark_leaks(frame, bench).collect()}
    want = brute(docs[:-1], items)
    assert {x for x in got if x[0] != 103} == want and len(want) > 25
    # Nothing with at most two differences in a full window is missed.
    full = {x[:2] for x in brute(docs[:-1], items, every=True) if x[4] == dc.WINDOW and x[5] >= dc.WINDOW - 2}
    assert full <= {x[:2] for x in got}
    assert (103, 3) in {x[:2] for x in got}
    kept = dc.drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    bad = {(d, t) for d, t in docs if any(x[0] == d and brute([(d, t)], items) for x in got)}
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(
        str(r) for r in frame.select("doc_id", "text").collect() if (r.doc_id, r.text) not in bad
    )


def test_masks_of_short_texts_hit_all_allowed_differences():
    for n in range(1, dc.WINDOW):
        masks = dc.masks_for(n)
        for gone in itertools.combinations(range(n), n - math.ceil(0.8 * n - 1e-9)):
            assert any(
                all(s + k not in gone for k, bit in enumerate(m) if bit == "1") for m in masks for s in range(n - len(m) + 1)
            ), (n, gone)


def test_short_texts_against_all_shifts(spark, tmp_path):
    """op2 and the pipeline's stage on texts of 5 to 12 words, with no mask in the brute force."""
    rng = random.Random(8)
    items = [(n, " ".join(f"t{n}x{i}" for i in range(n))) for n in range(5, 13)] + [(20, "a b c d e f g h")]
    docs = []
    for n, t in items:
        for k in (1, 2):
            for gone in itertools.combinations(range(len(t.split())), k):
                words = [f"z{rng.randrange(9)}" if i in gone else w for i, w in enumerate(t.split())]
                docs.append((len(docs), " ".join([*rng.choices("uvw", k=rng.randrange(4)), *words, "end"])))
    docs += [(900 + i, " ".join(rng.choices("abcdefgh", k=40))) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op2_benchmark_leaks"](spark, str(tmp_path)).collect()
    want = brute(docs, items, every=True)
    assert {(r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_window, r.n_equal) for r in got} == want
    assert {x[4] for x in want} == set(range(5, 13))
    kept = corpus_pipeline.benchmark_stage(spark, frame, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {x[0] for x in want}


def test_large_sides_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "SMALL_ROWS", 0)
    docs, items = make(random.Random(6))
    docs = docs[:40]
    got = dc.benchmark_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_window, r.n_equal) for r in got.collect()} == brute(docs, items)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n", "x")], SCHEMA)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.benchmark_leaks(docs, none).collect() == [] and dc.drop_leaks(docs, none).count() == 1
    bench = docs.selectExpr("doc_id AS item_id", "text")
    assert dc.benchmark_leaks(docs.limit(0), bench).collect() == [] and dc.drop_leaks(docs, bench).count() == 0
