from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cohortlake.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string, fingerprint string"


def brute_shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def words(rng, n, size=50):
    return " ".join(rng.choice(["Ab", "cd", "eé", "f"]) + str(rng.randrange(size)) for _ in range(n))


def test_hashes_follow_the_words():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 6, 40):
        text = words(rng, n)
        assert len(np.unique(fp.shingle_hashes(text))) == len(brute_shingles(text))
        spaced = " \t" + text.replace(" ", "\n \x0b").upper().replace("É", "é") + "\r"
        assert np.array_equal(fp.shingle_hashes(spaced), fp.shingle_hashes(text))
    assert not np.array_equal(fp.shingle_hashes("ab c"), fp.shingle_hashes("a bc"))
    assert not np.array_equal(fp.shingle_hashes("ab"), fp.shingle_hashes("ba"))
    assert len(fp.shingle_hashes("a b c")) == 1


def test_small_sets_are_exact():
    rng = random.Random(2)
    for _ in range(50):
        a = words(rng, rng.randrange(30), 3)
        b = " ".join((a + " " + words(rng, 5, 3)).split()[rng.randrange(4) :])
        x, y = fp.sketch(a), fp.sketch(b)
        sa, sb = brute_shingles(a), brute_shingles(b)
        assert fp.resemblance(x, y) == (len(sa & sb) / len(sa | sb) if sa | sb else 1)
        assert fp.containment(x, y) == (len(sa & sb) / len(sa) if sa else 1)
        assert fp.distinct_shingles(x) == len(sa)


def test_estimates_and_merges():
    rng = random.Random(3)
    for share in (0.2, 0.5, 0.9):
        base = words(rng, 4000).split()
        cut = int(len(base) * share)
        a, b = " ".join(base), " ".join(base[:cut] + words(rng, 1500).split())
        sa, sb = brute_shingles(a), brute_shingles(b)
        x, y = fp.sketch(a), fp.sketch(b)
        assert abs(fp.resemblance(x, y) - len(sa & sb) / len(sa | sb)) < 0.15
        assert abs(fp.containment(x, y) - len(sa & sb) / len(sa)) < 0.15
        assert abs(fp.distinct_shingles(x) / len(sa) - 1) < 0.35
    parts = [words(rng, 300) for _ in range(5)]
    whole = np.unique(np.concatenate([fp.shingle_hashes(p) for p in parts]))[: fp.K]
    merged = np.zeros(0, np.uint64)
    for p in parts:
        merged = fp.merge(merged, fp.sketch(p))
    assert np.array_equal(merged, whole)


def brute_edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    out = []
    for i, (ident, text, *_) in enumerate(order):
        text, follower = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + follower[:m]
        out.append((ident, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                    round(fp.resemblance(fp.sketch(text), fp.sketch(edited)), 9),
                    round(fp.resemblance(fp.sketch(text), fp.sketch(follower)), 9)))
    return sorted(map(str, out))


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_edited_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i * 7, words(rng, rng.randrange(200)), "x") for i in range(n)]
    if n > 2:
        rows += [(7, "the same id", "x"), (7, "the same id", "x"), (14, None, "x"), (15, "", "x"), (None, "null id", "x"),
                 (None, None, "x"), (10**15, "far away id \U0001f600 é", "x"), (70, words(rng, 30000), "x")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = fp.edited_fingerprints(docs).collect()
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))) for r in got) == brute_edited(rows)


def test_equal_texts_and_merged_frames(spark):
    rng = random.Random(9)
    rows = [(i % 3, words(rng, 400), "x") for i in range(12)] + [(2, None, "x"), (4, "", None), (None, "a b", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    parts = fp.document_fingerprints(docs)
    assert {tuple(r.fingerprint) for r in parts.filter("doc_id = 4").collect()} == {()}
    got = {r.doc_id: r.fingerprint for r in fp.merged_fingerprints(parts, ["doc_id"]).collect()}
    for key in {r[0] for r in rows}:
        whole = np.unique(np.concatenate([fp.shingle_hashes(t or "") for i, t, _ in rows if i == key]))[: fp.K]
        assert got[key] == whole.view(np.int64).tolist()
    assert fp.document_fingerprints(docs.limit(0)).collect() == []
    assert fp.merged_fingerprints(parts.limit(0), ["doc_id"]).collect() == []
