from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import toxicity

SCHEMA = "doc_id bigint, text string, score string"


def brute_marginals(emission, moves):
    total, on = 0.0, np.zeros(len(emission))
    for path in itertools.product((0, 1), repeat=len(emission)):
        x = math.exp(sum(e for e, y in zip(emission, path) if y) + sum(moves[2 * a + b] for a, b in zip(path, path[1:])))
        total += x
        on += x * np.array(path)
    return on / total


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    crf = toxicity.Crf(bits=4, moves=rng.normal(size=4))
    lengths = np.array([3, 1, 7, 2, 7])
    emission = rng.normal(size=lengths.sum()) * 3
    got = toxicity.marginals(crf, emission, lengths)
    want = np.concatenate([brute_marginals(e, crf.moves) for e in np.split(emission, np.cumsum(lengths)[:-1])])
    assert np.allclose(got, want)


def sample(rng, n):
    clean = [f"{a}{b}" for a in "ba re ti mo lu".split() for b in "ka no si pe".split()]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.randrange(20, 60)) + [f"u{rng.randrange(10**6)}"]
        y = int(rng.random() < 0.4)
        for _ in range(y * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(["Grob", "grimm" + rng.choice(clean)]))
        texts.append(" ".join(words))
        labels.append(y)
    return texts, labels


@pytest.fixture(scope="module")
def field():
    return toxicity.fit(*sample(random.Random(2), 400))


def test_held_out_accuracy_and_unseen_endings(field):
    texts, labels = sample(random.Random(3), 200)
    texts += ["baka grimmxyz rino", "baka rino", "the grob one"]
    labels += [1, 0, 1]
    docs = [toxicity.tokens_of(t) for t in texts]
    lengths = np.array([len(d) for d in docs])
    p = toxicity.marginals(field, field.emission([t for d in docs for t in d]), lengths)
    score = np.maximum.reduceat(p, np.cumsum(lengths) - lengths)
    assert ((score >= toxicity.THRESHOLD) == np.array(labels, bool)).mean() > 0.97
    assert list(score[-3:] >= toxicity.THRESHOLD) == [True, False, True]


def test_scores_and_spans(spark, field):
    long = " ".join(["baka rino"] * 30000) + " grob"
    rows = [(1, "Baka, GROB grimmka! rino", "x"), (2, None, "x"), (3, "", None), (4, "...", "x"), (5, long, "x"),
            (None, "grob", "x"), (6, "İİ grob", "x"), (6, "İİ grob", "x"), (7, "rino baka", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit(1))
    got = toxicity.score_documents(docs, field).collect()
    assert len(got) == len(rows)
    of = {r["id"]: r for r in got}
    texts = {i: t for i, t, _ in rows}
    assert [[texts[i][s["start"] : s["end"]] for s in of[i]["spans"]] for i in (1, 5, None, 6)] == [
        ["GROB grimmka"], ["grob"], ["grob"], ["grob"]
    ]
    assert all(of[i]["score"] == 0 and of[i]["spans"] == [] for i in (2, 3, 4)) and 0 < of[7]["score"] < 0.3


def test_training_rows_and_filter(spark):
    texts, labels = sample(random.Random(4), 300)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, None), (900, None, "y")], SCHEMA)
    marks = spark.createDataFrame(
        [(i, y) for i, y in enumerate(labels)] + [(0, None), (None, 1), (900, 0), (5, labels[5])], "doc_id bigint, toxic int"
    )
    got, y = zip(*[(r.text, r.y) for r in toxicity.training_rows(docs, marks, most=60).collect()])
    assert sum(y) <= 60 and len(y) - sum(y) <= 60 and len(y) > 100
    known = dict(zip(texts, labels))
    held = {r.doc_id for r in docs.filter(toxicity.held_out()).collect()}
    assert held and all(known.get(t, 0) == n for t, n in zip(got, y))
    assert not {texts.index(t) for t in got if t} & held
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert None in ids and 900 in ids
    wrong = [i for i, n in enumerate(labels) if (i in ids) == bool(n)]
    assert len(wrong) < 6


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.drop_toxic(docs, none).count() == 1
    assert toxicity.drop_toxic(docs.limit(0), none).collect() == []
