from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer, models

from cohortlake.llm import token_counts as tc
from cohortlake.llm.queries import VOCABULARY

SCHEMA = "doc_id bigint, text string, n_tokens string"


def brute(model, text):
    """(score, tokens) of the best of all segmentations."""
    best = None
    for cut in range(1 << max(0, len(text) - 1)):
        parts, start = [], 0
        for i in range(len(text)):
            if i == len(text) - 1 or cut >> i & 1:
                parts.append(text[start : i + 1])
                start = i + 1
        if any(len(p) > 1 and p not in model.scores for p in parts):
            continue
        score, n = 0.0, 0
        for p in parts:
            spelled = len(p.encode())
            if p in model.scores and not (len(p) == 1 and (model.unknown * spelled, -spelled) > (model.scores[p], -1)):
                score, n = score + model.scores[p], n + 1
            else:
                score, n = score + model.unknown * spelled, n + spelled
        if best is None or (score, -n) > (best[0], -best[1]):
            best = (score, n)
    return best or (0.0, 0)


def test_all_segmentations():
    rng = random.Random(1)
    letters = "abcé▁"
    for _ in range(20):
        pieces = {"".join(rng.choices(letters, k=rng.randrange(1, 5))): -float(rng.randrange(1, 9)) for _ in range(12)}
        model = tc.Unigram(pieces)
        trie = tc.Trie(model)
        for _ in range(20):
            word = "".join(rng.choices("abcéd", k=rng.randrange(1, 9)))
            assert trie.count(word) == brute(model, "▁" + word)[1]


@pytest.fixture(scope="module")
def model():
    return tc.sentencepiece_unigram(VOCABULARY)


def test_against_another_implementation(model):
    vocabulary = [("<unk>", model.unknown * 4), *model.scores.items()]
    other = Tokenizer(models.Unigram(vocabulary, unk_id=0))
    trie, rng = tc.Trie(model), random.Random(2)
    words = ["tionthly", "the", "unbelievable", "internationalisation", "Straße", "idiot", "x", "mañana", "l'école"]
    words += ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 14))) for _ in range(300)]
    scored = 0
    for w in words:
        tokens = other.encode("▁" + w).tokens
        best = model.states("▁" + w)[-1]
        if all(t in model.scores for t in tokens):
            scored += 1
            assert best[0] == pytest.approx(sum(model.scores[t] for t in tokens))
            assert trie.count(w) <= len(tokens)
    assert scored > 250


def test_prefixes_are_scored_once(model, monkeypatch):
    trie, calls = tc.Trie(model), []
    extend = tc.Unigram.extend
    monkeypatch.setattr(tc.Unigram, "extend", lambda self, text, end, best: calls.append(text[:end]) or extend(self, text, end, best))
    for w in ("interest", "interests", "internal", "interest"):
        trie.count(w)
    assert len(calls) == len(set(calls)) == trie.nodes == len("▁interests") + len("nal")
    monkeypatch.setattr(tc, "MOST_NODES", 5)
    assert [trie.count(w) for w in ("interest", "zebra", "interest")][::2] == [tc.Trie(model).count("interest")] * 2


def test_frames(spark, model):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "\t\x0b"]).join("".join(rng.choices("thelaeé😀", k=rng.randrange(1, 9))) for _ in range(rng.randrange(50))), "x")
            for i in range(40)]
    rows += [(50, None, "x"), (51, "", None), (52, " \n", "x"), (None, "the the", "x"), (53, "a" * 3000 + " b", "x"), (54, "the " * 50000, "x"), rows[0],
             (55, "no break", "x")]
    got = tc.token_counts(spark.createDataFrame(rows, SCHEMA), VOCABULARY).collect()
    trie = tc.Trie(model)
    want = [(i, len(tc.PRETOKEN.findall(t or "")), sum(trie.count(w) for w in tc.PRETOKEN.findall(t or ""))) for i, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert tc.token_counts(spark.createDataFrame([], SCHEMA), VOCABULARY).collect() == []


def test_a_step_tries_only_starts_that_a_piece_can_have():
    class Watched(dict):
        tried = 0

        def get(self, key):
            self.tried += 1
            return super().get(key)

    long = "x" * 30 + "yz"
    model = tc.Unigram({"▁": -1.0, "b": -2.0, "cab": -3.0, long: -4.0})
    model.ends = Watched(model.ends)
    # At the last b of "acab": b, ab, cab and acab, which ends no piece; at c and a one each.
    for word, tried in (("b", 1 + 2), ("acab", 1 + 1 + 1 + 1 + 4), (long, None)):
        model.ends.tried = 0
        got = model.states("▁" + word)[-1]
        assert (round(got[0], 6), -got[1]) == (brute(model, "▁" + word) if tried else (-5.0, 2))
        assert tried is None or model.ends.tried == tried
