from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cohortlake.llm import quality

SCHEMA = "doc_id bigint, text string, score string"


def test_accuracies_are_recovered():
    rng = random.Random(1)
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.7, 0.9, 0.6, 0.8]
    truth, votes = [], []
    for _ in range(20000):
        y = rng.random() < 0.7
        truth.append(y)
        votes.append(quality.pattern([-1 if rng.random() < 0.3 else int(y == (rng.random() < a)) for a in accuracy]))
    model = quality.fit_labels(Counter(votes), strength=0.0)
    assert np.abs(model.accuracies() - accuracy).max() < 0.03 and abs(model.prior - 0.7) < 0.03
    right = (model.posterior(votes) >= 0.5) == np.array(truth)
    majority = np.array([v.count("+") >= v.count("-") for v in votes]) == np.array(truth)
    assert right.mean() > majority.mean()


def posterior_by_hand(model, pattern):
    p = [1 - model.prior, model.prior]
    for y in (0, 1):
        for i, c in enumerate(pattern):
            p[y] *= 1 if c == "0" else model.chances[y][i][int(c == "+")]
    return p[1] / sum(p)


def test_posterior_by_hand():
    model = quality.fit_labels({"++0": 50, "+-0": 10, "--+": 20, "-0-": 20, "000": 5})
    for p in ("++0", "+-+", "000", "---"):
        assert np.isclose(model.posterior([p])[0], posterior_by_hand(model, p))
    assert quality.fit_labels({}).posterior(["0" * len(quality.LABELLERS)])[0] == 0.5


def sample(rng, n):
    content = [f"{a}{b}{c}" for a in "wor tal mon ber lin gar fen sol".split() for b in "ki so da ter ti ne lo".split() for c in "n s x ly ro".split()]
    texts, good = [], []
    for _ in range(n):
        kind = rng.choice(["good"] * 5 + ["symbols", "capitals", "repeats", "lines"])
        sentences = [
            " ".join(rng.choice([rng.choice(content), rng.choice(content), rng.choice(["the", "of", "and", "to"])]) for _ in range(rng.randrange(6, 14)))
            for _ in range(rng.randrange(4, 12))
        ]
        sentences = [x.capitalize() + "." for x in sentences]
        if kind == "symbols":
            sentences = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in s.split()) for s in sentences]
        elif kind == "capitals":
            sentences = [" ".join(w.upper() + "!!" for w in s.split()) for s in sentences]
        elif kind == "repeats":
            sentences = [" ".join([rng.choice(content).title()] * 80)]
        elif kind == "lines":
            sentences = ["Home | Next | Menu"] * 30
        texts.append("\n".join(sentences))
        good.append(kind == "good")
    return texts, good


def test_scorer_against_the_truth(spark):
    texts, good = sample(random.Random(2), 400)
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    extra = [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (None, texts[0], "x"), (903, texts[good.index(True)] * 300, "x"), rows[3]]
    docs = spark.createDataFrame(rows + extra, SCHEMA).withColumn("votes", F.lit(1))
    scorer = quality.train(docs, sample=200)
    counts = quality.vote_counts(docs)
    assert sum(counts.values()) == len(rows) + len(extra)
    got = quality.score_quality(docs, scorer).collect()
    assert len(got) == len(rows) + len(extra)
    of = {r.doc_id: r for r in got}
    keep = np.array([of[i].keep for i in range(len(texts))])
    assert (keep == np.array(good)).mean() > 0.95
    assert all(r.predicted == int(r.keep) == int(r.score >= 0.5) for r in got)
    assert of[900].votes == of[901].votes == "0" * 7 + "-"
    features = quality.Features()
    assert all(of[i].votes == quality.pattern(features.of(texts[i])[0]) for i in range(50))
    assert np.isclose(of[5].posterior, posterior_by_hand(scorer.labels, of[5].votes))


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality.score_quality(docs, quality.train(docs)).collect() == []


def test_words_are_measured_once():
    features = quality.Features()
    for text in ("Good day.", "A### b$$ C!!!", "x", "ÄÖ Straße 12 3,4"):
        votes, shares = features.of(text)
        assert len(votes) == len(quality.LABELLERS) and abs(sum(v for v in shares.values()) - 1 - 9) < 1e-9


def em_text_by_text(votes, rounds=200, alarm=0.03, catch=0.5, strength=0.5):
    """Expectation-maximisation with a loop over texts and labellers; posteriors by text."""
    n, size = len(votes), len(votes[0])
    good = [(v.count("+") + 1) / (v.count("+") + v.count("-") + 2) for v in votes]
    for _ in range(rounds):
        of_class = [[1 - g for g in good], good]
        chance = []
        for y, (weights, against) in enumerate(zip(of_class, (catch, alarm))):
            total, own = sum(weights), []
            for j in range(size):
                prior = 1 + strength * total
                minus = sum(w for w, v in zip(weights, votes) if v[j] == "-") + against * prior
                plus = sum(w for w, v in zip(weights, votes) if v[j] == "+") + (1 - against) * prior
                own.append({"-": minus / (minus + plus), "+": plus / (minus + plus), "0": 1.0})
            chance.append(own)
        prior = min(max(sum(good) / n, 1e-6), 1 - 1e-6)
        before, good = good, []
        for v in votes:
            p = [1 - prior, prior]
            for y in (0, 1):
                for j, c in enumerate(v):
                    p[y] *= chance[y][j][c]
            good.append(p[1] / (p[0] + p[1]))
        if max(abs(a - b) for a, b in zip(good, before)) < 1e-9:
            break
    return good


def scorer_text_by_text(rows, target, rounds=300, decay=1e-3):
    """Logistic scores trained with a loop over texts and slots."""
    weights, sums, bias, bias_sum = {}, {}, 0.0, 1e-8
    for _ in range(rounds):
        gradient, gb = {s: -decay * w / len(rows) for s, w in weights.items()}, 0.0
        for row, t in zip(rows, target):
            z = sum(weights.get(s, 0.0) * v for s, v in row.items()) + bias
            pull = (t - 1 / (1 + np.exp(-z))) / len(rows)
            gb += pull
            for s, v in row.items():
                gradient[s] = gradient.get(s, 0.0) + pull * v
        for s, g in gradient.items():
            sums[s] = sums.get(s, 1e-8) + g * g
            weights[s] = weights.get(s, 0.0) + 0.5 * g / np.sqrt(sums[s])
        bias_sum += gb * gb
        bias += 0.5 * gb / np.sqrt(bias_sum)
    return lambda row: 1 / (1 + np.exp(-(sum(weights.get(s, 0.0) * v for s, v in row.items()) + bias)))


def test_query_against_loops_over_texts(spark, tmp_path):
    texts, _ = sample(random.Random(5), 30)
    texts += ["", "Short.", texts[0]]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    features = quality.Features()
    found = [features.of(t) for t in texts]
    votes = [quality.pattern(v) for v, _ in found]
    posterior = dict(zip(texts, em_text_by_text(votes)))
    distinct = sorted(set(texts))
    shares = [features.of(t)[1] for t in distinct]
    score = scorer_text_by_text(shares, [posterior[t] for t in distinct])
    from cohortlake.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].votes == votes[i]
        assert np.isclose(got[i].posterior, posterior[t], atol=1e-6)
        assert np.isclose(got[i].score, score(found[i][1]), atol=1e-4)
        assert got[i].predicted == int(got[i].score >= quality.THRESHOLD)
