from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlake.llm import mixing
from cohortlake.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, id string"
WEIGHT = {"en": 3, "de": 2, "fr": 0, "(none)": 1}


def levels():
    lang = F.col("lang")
    weight = F.when(lang == "en", 3).when(lang == "de", 2).when(lang == "fr", 0).otherwise(1)
    return [mixing.Level("language", lang, weight), mixing.Level("origin", F.col("source"), F.length("source"))]


def fill(budget, children):
    """{name: (cap, weight)} -> {name: budget}, one step of filling at a time."""
    out, left = {}, {n: (c, w) for n, (c, w) in children.items() if c and w}
    while left:
        total = sum(w for _, w in left.values())
        full = [n for n, (c, w) in left.items() if c * total <= budget * w]
        if not full:
            break
        least = min(full, key=lambda n: (Fraction(left[n][0], left[n][1]), n))
        out[least], _ = left.pop(least)
        budget -= out[least]
    if left:
        total = sum(w for _, w in left.values())
        parts = {n: divmod(budget * w, total) for n, (_, w) in left.items()}
        over = budget - sum(p for p, _ in parts.values())
        for i, n in enumerate(sorted(parts, key=lambda n: (-parts[n][1], n))):
            out[n] = parts[n][0] + (i < over)
    return out


def brute_budgets(leaves, budget, epochs):
    """leaves: {(lang, source): tokens}"""
    cap = {k: t * epochs * (WEIGHT.get(k[0], 1) > 0) * (len(k[1]) > 0 and k[1] != "(none)") for k, t in leaves.items()}
    top = {}
    for (lang, _), c in cap.items():
        top[lang] = top.get(lang, 0) + c
    budget, out = min(budget, sum(cap.values())), {}
    for lang, b in fill(budget, {k: (c, WEIGHT.get(k, 1)) for k, c in top.items()}).items():
        for source, n in fill(b, {s: (c, len(s)) for (k, s), c in cap.items() if k == lang}).items():
            out[lang, source] = n
    return {k: v for k, v in out.items() if v}


def brute_mix(rows, budget, epochs, seed):
    docs = [(i, t, lang or "(none)", source if source is not None else "(none)", len((t or "").split())) for i, t, lang, source in rows]
    docs = [d for d in docs if d[4]]
    leaves = {}
    for d in docs:
        leaves[d[2:4]] = leaves.get(d[2:4], 0) + d[4]
    out = []
    for leaf, b in brute_budgets(leaves, budget, epochs).items():
        whole, rest = divmod(b, leaves[leaf])
        own = [d for d in docs if d[2:4] == leaf]

        def place(d, whole=whole):
            digest = hashlib.md5(d[1].encode()).hexdigest()
            name = "|".join([str(seed), str(whole + 1), "" if d[0] is None else str(d[0]), digest])
            return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)

        for e in range(whole):
            out += [(d[0], *leaf, e + 1, d[4], d[4]) for d in own]
        for d in sorted(own, key=place):
            if rest > 0:
                out.append((d[0], *leaf, whole + 1, d[4], min(rest, d[4])))
            rest -= d[4]
    return sorted(map(str, out))


def documents(rng, n=150):
    rows = [(i, " ".join(rng.choices(["a", "bé", "c"], k=rng.randrange(40))), rng.choice(["en", "en", "de", "fr", "xx", None]),
             rng.choice(["s", "tt", "uuu", "uuu", "uuu"])) for i in range(n)]
    rows += [(500, None, "en", "s"), (501, " ", "en", "s"), (502, "x y", "en", None), (None, "p q r", "de", "s"),
             (7, "the same", "en", "tt"), (7, "the same", "en", "tt"), (7, "not the same", "en", "tt"), (503, "big " * 3000, "en", "tt")]
    return rows


@pytest.mark.parametrize("budget", [0, 1, 500, 3000, 7001, 10**9])
def test_against_one_step_at_a_time(spark, budget):
    rows = documents(random.Random(budget))
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    got = mixing.mix(docs, levels(), F.lit(budget), seed=3, max_epochs=2).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_mix(rows, budget, 2, 3)
    if budget == 3000:
        assert sum(r.taken for r in got) == budget


def test_shortage_goes_to_siblings_first(spark):
    rows = [("en", "a", 10, 1, 1), ("en", "b", 1000, 1, 1), ("de", "c", 1000, 1, 1)]
    leaves = spark.createDataFrame(rows, "lang string, source string, tokens bigint, weight_lang int, weight_source int")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, ["lang", "source"], F.lit(400), 1).collect()}
    assert got == {"a": 10, "b": 190, "c": 200}
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, ["lang", "source"], F.lit(2006), 1).collect()}
    assert got == {"a": 10, "b": 996, "c": 1000} or got == {"a": 10, "b": 1000, "c": 996}


def test_sources_without_a_number(spark, tmp_path):
    domain_of = {"src3": "domain3", "src12": "domain0", "": "(none)", "web": "(none)", None: "(none)",
                 "crawl 98765432109876543211": "domain3", "a6b7": "domain2", "00": "domain0"}
    rows = [(i, "w " * 30, "en", s) for i, s in enumerate(list(domain_of) * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_source_mix"](spark, str(tmp_path)).collect()
    assert sum(r.taken for r in got) == 30 * len(rows) // 2
    named = {("(none)" if s is None else s, d) for s, d in domain_of.items()}
    assert {(r.source, r.domain) for r in got} == named
    mixed = corpus_pipeline.mix_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.epoch, r.taken) for r in mixed) == sorted((r.doc_id, r.epoch, r.taken) for r in got)


def test_texts_and_empty(spark):
    rows = documents(random.Random(5), 60)
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    got = mixing.mixed_texts(docs, levels(), F.lit(900), seed=3, max_epochs=2).collect()
    assert sorted(str((r.doc_id, r.language, r.origin, r.epoch, r.n_tokens, r.taken)) for r in got) == brute_mix(rows, 900, 2, 3)
    texts = {t for _, t, _, _ in rows if t}
    assert all(len(r.text.split()) == r.taken and any(t.startswith(r.text) for t in texts) for r in got)
    assert any(r.taken < r.n_tokens for r in got)
    assert mixing.mix(docs.limit(0), levels(), F.lit(9)).collect() == []
    assert mixing.mix(docs, levels(), F.lit(None)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, [mixing.Level("n", F.col("lang"), F.lit(1))], F.lit(9))
