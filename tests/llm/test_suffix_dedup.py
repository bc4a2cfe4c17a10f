from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cohortlake.llm import suffix_dedup as sd

SCHEMA = "doc_id bigint, text string, spans string, key string"


def brute(rows, least=50):
    owner = {}
    inf = sd.LAST_ID
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - least + 1):
            s = data[p : p + least]
            owner[s] = min(owner.get(s, inf), inf if i is None else i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - least + 1):
            if owner[data[p : p + least]] < (inf if i is None else i):
                gone[p : p + least] = True
        runs = int(np.sum(gone[:-1] & ~np.r_[False, gone[:-2]])) if len(data) else 0
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def documents(rng, n=60):
    vocabulary = ["the", "of", "é", "ab", "abab", "a", "Straße", "x" * 9, "😀"]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passages = [text(rng.randrange(8, 40)) for _ in range(8)]
    rows = []
    for i in range(n):
        t = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            p = p[rng.randrange(1 + len(p) // 2) :][: rng.randrange(1 + len(p))]
            at = rng.randrange(len(t) + 1)
            t = t[:at] + p + t[at:]
        rows.append((i * 3, t))
    rows += [(500, rows[4][1]), (501, rows[4][1]), (502, None), (503, ""), (504, "a" * 49), (505, "a" * 50), (506, "a" * 300),
             (507, "ab" * 200), (508, "b" + "ab" * 90), (9, rows[5][1]), (9, rows[5][1]), (None, rows[6][1]), (None, "a" * 60),
             (510, rows[7][1] * 400)]
    rng.shuffle(rows)
    return rows


def test_cover_has_a_shift_for_all_residues():
    assert all(
        any((r + d) % sd.PERIOD in sd.COVER and (s + d) % sd.PERIOD in sd.COVER for d in range(sd.PERIOD))
        for r in range(sd.PERIOD) for s in range(sd.PERIOD)
    )


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_pieces_hold_every_suffix_once(monkeypatch, block):
    monkeypatch.setattr(sd, "HASH_BYTES", block)
    rng = random.Random(1)
    texts = [t.encode() for _, t in documents(rng, 20) if t is not None]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    data = np.frombuffer(b"".join(texts), np.uint8)
    value, start, count = sd.pieces(data, offsets)
    got = np.concatenate([np.arange(s, s + n) for s, n in zip(start, count)])
    want = np.concatenate([np.arange(o, o + max(0, len(t) - 49)) for o, t in zip(offsets, texts)])
    assert np.array_equal(got, want) and count.max() <= 50
    of = {}
    for v, s, n in zip(value.tolist(), start.tolist(), count.tolist()):
        for p in range(s, s + n):
            assert of.setdefault(data[p : p + 50].tobytes(), v) == v


def test_owners_of_a_block():
    rng = random.Random(2)
    parts = [t.encode() for _, t in documents(rng, 25) if t is not None and len(t.encode()) >= 50]
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])]
    owner = np.array([rng.randrange(10) for _ in parts])
    text = np.frombuffer(b"".join(parts), np.uint8)
    at, got = sd.first_owners(text, offsets, owner)
    least = {}
    for p, o in zip(parts, owner):
        for i in range(len(p) - 49):
            least[p[i : i + 50]] = min(o, least.get(p[i : i + 50], 99))
    assert [least[text[i : i + 50].tobytes()] for i in at] == got.tolist() and len(at) == sum(len(p) - 49 for p in parts)


def test_against_all_strings(spark):
    rows = documents(random.Random(3))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = sorted(str(tuple(r)) for r in sd.repeated_text(docs).collect())
    assert got == brute(rows)
    assert sum("0, 0" not in r for r in got) > 15


def test_small_blocks_and_full_filter(spark, monkeypatch):
    rows = documents(random.Random(4), 30)
    monkeypatch.setattr(sd, "BLOCK_BYTES", 200)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(str(tuple(r)) for r in sd.repeated_text(docs, least=30, gram=9).collect()) == brute(rows, 30)
    words = np.full(1 << 10, np.uint64(2**64 - 1))
    assert sd.in_filter(words, np.arange(99, dtype=np.uint64)).all()


def test_hot_minimiser_is_shared_out(spark, monkeypatch):
    """A frequent 16-byte string in many contexts: no task gets all its pieces."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    some = lambda k: "".join(rng.choices(letters, k=k))
    common = min((some(16) for _ in range(4000)), key=lambda t: sd.gram_hashes(np.frombuffer(t.encode(), np.uint8), 16)[0])
    rows = [(i, some(rng.randrange(40, 80)) + common + some(rng.randrange(40, 80))) for i in range(300)]
    for i in range(40):
        t = rng.choice(rows)[1]
        rows.append((1000 + i, some(9) + t[rng.randrange(30) : len(t) - rng.randrange(30)] + some(9)))
    rows += [(2000, rows[0][1]), (None, rows[1][1]), (2001, None), (2002, "")]
    sorted_blocks = sd._sorted_blocks

    def watched(least):
        run = sorted_blocks(least)

        def checked(batches):
            def seen():
                for batch in batches:
                    h = batch.column(0).to_numpy()
                    if len(h) and np.unique(h, return_counts=True)[1].max() > 64:
                        raise ValueError("a bucket was sent whole")
                    yield batch

            return run(seen())

        return checked

    monkeypatch.setattr(sd, "HOT_PIECES", 60, raising=False)
    monkeypatch.setattr(sd, "_sorted_blocks", watched)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(str(tuple(r)) for r in sd.repeated_text(docs).collect()) == brute(rows)
    # The same where every bucket of two pieces is split.
    monkeypatch.setattr(sd, "HOT_PIECES", 1)
    assert sorted(str(tuple(r)) for r in sd.repeated_text(docs).collect()) == brute(rows)


def test_texts_are_cut(spark):
    rows = documents(random.Random(5), 30)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    kept = sd.without_repeats(docs)
    assert kept.columns == docs.columns
    judged = {(r.doc_id, r.n_bytes): r for r in sd.repeated_text(docs).collect()}
    for r in kept.collect():
        if r.doc_id == 501:
            assert r.text == ""
        if r.doc_id == 502:
            assert r.text is None
    assert kept.count() == docs.count()
    untouched = {i for i, t in rows if judged[(i, len((t or "").encode()))].n_removed == 0}
    after = {(r.doc_id, r.text) for r in kept.collect()}
    assert all((i, t) in after for i, t in rows if i in untouched)
    assert sd.without_repeats(docs.limit(0)).collect() == [] and sd.repeated_text(docs.limit(0)).collect() == []


def kept_text(rows, row, least=50):
    """A row's text without the strings that smaller ids have, its broken characters dropped."""
    if row[1] is None:
        return None
    data = row[1].encode()
    others = {o[p : p + least] for i, t, *_ in rows if t and i < row[0] for o in [t.encode()] for p in range(len(o) - least + 1)}
    gone = np.zeros(len(data), bool)
    for p in range(len(data) - least + 1):
        if data[p : p + least] in others:
            gone[p : p + least] = True
    return bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
