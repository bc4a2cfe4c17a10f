from __future__ import annotations

import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortlake.llm import components, simhash

SCHEMA = "doc_id bigint, text string"


def brute_fingerprint(text, shingle=4):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if word:
                words.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    parts = [words] if 0 < len(words) < shingle else [words[i : i + shingle] for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts if p]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, radius):
    """fps: list of (id, fp); the least id reachable, by position."""
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    least = {}
    for (i, _), x in zip(fps, label):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [least.get(x) for x in label]


def test_masks_hide_any_positions():
    rng = random.Random(1)
    for radius in (1, 2, 4):
        found = simhash.masks(radius)
        assert len(found) == 2 ** (radius + 1) - 1
        for _ in range(300):
            bits = rng.sample(range(64), radius)
            diff = sum(1 << b for b in bits)
            assert any(m & diff == 0 for m in found)


def test_forest_joins_what_pairs_join():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for b in base for _ in range(30)})
    a, b = simhash.tree_links(np.array(fps, np.uint64), 4)
    assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b))
    want = brute_components([(i, f) for i, f in enumerate(fps)], 4)
    assert len(a) == len(fps) - len(set(want))


def test_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"W{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(30)]
    for i in range(30, 110):
        words = rows[rng.randrange(30)][1].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", "\x0b"]).join(words)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "One"), (204, "one"), (205, "a b c"), (None, rows[3][1])]
    rows += [(206, "x y \u0085 Ä b"), (206, "x y \u0085 Ä b"), (5, "other text under the id of another one")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("clash")).withColumn("fp", F.lit(1))
    got = sorted(map(str, ((r[0], r[1] & (2**64 - 1), r[2]) for r in simhash.near_copies(docs).collect())))
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted(map(str, ((i, f, c) for (i, f), c in zip(fps, brute_components(fps, 4)))))
    assert got == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    firsts = {c for c in brute_components(fps, 4)}
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").select("doc_id").distinct().collect()) == sorted(firsts - {None})


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_copies(docs).collect() == []
    assert simhash.drop_near_copies(docs).columns == ["doc_id", "text"]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    links += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    label = {x: x for p in links for x in p}
    for a, b in links * 60:
        label[a] = label[b] = min(label[a], label[b])
    assert got == {x: r for x, r in label.items() if x != 200}


def test_one_row_of_each_group_stays(spark):
    """Rows that share an id with different texts, equal rows, and rows without an id."""
    rows = [(1, "A A A B", "x"), (5, "C C C D", "x"), (5, "A A A B", "x"), (7, "c c c d", "y"), (8, "E", "x"), (8, "E", "z"),
            (None, "F G", "x"), (None, "F G", "x"), (None, "f g", "x"), (9, None, "x"), (10, "", "x"), (None, "c c c d", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key string")
    kept = simhash.drop_near_copies(docs, shingle=4, radius=0)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect())
    assert got == [(0, "f g"), (1, "a a a b"), (5, "c c c d"), (8, "e"), (9, "")]
    assert simhash.drop_near_copies(docs.limit(0)).collect() == []


def test_one_row_of_each_group_by_brute_force(spark):
    rng = random.Random(12)
    base = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(25)]
    rows = [(rng.choice([None, *range(20)]), rng.choice(base)) for _ in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fps = [(i, brute_fingerprint(r[1])) for i, r in enumerate(rows)]
    groups = {}
    for r, c in zip(rows, brute_components(fps, 4)):
        groups.setdefault(c, []).append(r)
    least = [min((i is None, i or 0) for i, _ in g) for g in groups.values()]
    got = [(r.doc_id is None, r.doc_id or 0) for r in simhash.drop_near_copies(docs).collect()]
    assert sorted(got) == sorted(least)
