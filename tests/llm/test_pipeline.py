"""The pipeline against its stages worked out document by document."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from cohortlake.llm import toxicity
from cohortlake.llm.queries import ORACLES, QUERIES
from tests.llm import test_decontaminate, test_simhash, test_suffix_dedup
from tests.llm.test_mixing import fill

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(rng):
    vocabulary = [f"{a}{b}" for a in "wor tal mon ber lin gar".split() for b in "ki so da te no".split()]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, items = text(60), [(i, text(25)) for i in range(4)]
    rows, toxic = [], []
    for i in range(260):
        words = text(rng.randrange(30, 90)).split()
        y = i % 3 == 0
        for _ in range(2 * y):
            words.insert(rng.randrange(len(words)), "grob" + rng.choice(["", "en", "er", "ian"]))
        if i % 7 == 1:
            words[10:10] = passage.split()
        if i % 20 == 2:
            words[5:5] = rng.choice(items)[1].split()
        rows.append((i, " ".join(words), rng.choice(["en", "de", "fr"]), f"src{i % 6}"))
        toxic.append(int(y))
    for i in range(30):
        base = rng.choice(rows)
        rows.append((300 + i, base[1] + " end" * (i % 2), "en", base[3]))
    rows += [(400, None, "en", "src1"), (401, "", None, "src1"), (402, "kurz", "de", None)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows], list(enumerate(toxic)), items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels, items = documents(random.Random(1))
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_every_stage_against_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    crf = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    def score(text):
        tokens = toxicity.tokens_of(text or "")
        return toxicity.marginals(crf, crf.emission(tokens), np.array([len(tokens)])).max() if tokens else 0.0

    want = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]
    assert 100 < len(want) < len(rows) - 60
    states = [want]
    fps = [(r[0], test_simhash.brute_fingerprint(r[1])) for r in want]
    want = [r for r, c in zip(want, test_simhash.brute_components(fps, 4)) if r[0] == c]
    states.append(want)
    cut = {r[0]: test_suffix_dedup.kept_text(want, r) for r in want}
    want = [(r[0], cut[r[0]], *r[2:4], None if cut[r[0]] is None else len(cut[r[0]])) for r in want]
    assert [r[1] for r in want] != [r[1] for r in states[-1]]
    states.append(want)
    leaks = {x[0] for x in test_decontaminate.brute([(r[0], r[1]) for r in want], items)}
    want = [r for r in want if r[0] not in leaks]
    states.append(want)
    assert len(states[0]) > len(states[1]) and len(states[2]) > len(states[3])
    for (_, stage), expected in zip(corpus_pipeline.STAGES, states):
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected))
        docs = spark.createDataFrame(expected, SCHEMA)
    final = corpus_pipeline.run(spark, folder).collect()
    check_mix(final, want)
    check_mix(corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect(), want)


def check_mix(got, docs):
    """Budgets as filled step by step; whole epochs of all a leaf has, and a prefix of one."""
    leaves, texts = {}, {r[0]: r[1] for r in docs}
    for i, text, lang, source, _ in docs:
        n = len((text or "").split())
        number = int(source[3:]) if source else None
        if n:
            domain = "(none)" if number is None else f"domain{number % 4}"
            leaves.setdefault((domain, lang or "(none)", source or "(none)"), {})[i] = n
    cap = {k: 2 * sum(v.values()) for k, v in leaves.items()}
    weight = {"domain0": 4000, "en": 4000, "de": 3000}
    domains, budget = {}, sum(cap.values()) // 4
    for k, c in cap.items():
        domains[k[0]] = domains.get(k[0], 0) + c
    taken = {}
    for r in got:
        taken.setdefault((r.domain, r.lang, r.source), []).append(r)
        text = texts[r.doc_id]
        assert len(r.text.split()) == r.taken and text.startswith(r.text) and r.text.rstrip() == (r.text if r.taken < r.n_tokens else text.rstrip())
        assert leaves[r.domain, r.lang, r.source][r.doc_id] == r.n_tokens
    for domain, b in fill(budget, {k: (c, weight.get(k, 2000)) for k, c in domains.items()}).items():
        langs = {}
        for k, c in cap.items():
            if k[0] == domain:
                langs[k[1]] = langs.get(k[1], 0) + c
        for lang, bb in fill(b, {k: (c, weight.get(k, 1500)) for k, c in langs.items()}).items():
            own = {k[2]: (c, 1) for k, c in cap.items() if k[:2] == (domain, lang)}
            for source, n in fill(bb, own).items():
                rows = taken.pop((domain, lang, source), [])
                assert sum(r.taken for r in rows) == n
                whole = n // sum(leaves[domain, lang, source].values())
                for e in range(1, whole + 1):
                    assert {r.doc_id: r.taken for r in rows if r.epoch == e} == leaves[domain, lang, source]
                assert sum(r.taken < r.n_tokens for r in rows) <= 1
    assert not taken


def test_empty_tables(spark, tables, tmp_path):
    folder = tables[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
