"""Toxic spans and document scores from a linear-chain conditional random field."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import in_chunks, text_or_empty

TOKEN = re.compile(r"\w+")
THRESHOLD = 0.3
# Sizes of the chunks in which chains are worked out, and of the cache of token weights.
CHUNK_TOKENS = 400_000
CACHE_TOKENS = 300_000


def lowered(text: str) -> str:
    """Lower case with offsets kept: letters whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(lowered(text))


def features_of(token: str) -> list[str]:
    """The token itself and its beginnings of four to six characters: stems take endings."""
    return [f"w={token}", *(f"p={token[:n]}" for n in range(4, 7) if len(token) > n)]


@dataclass
class Crf:
    """Two labels, 0 clean and 1 toxic.

    ``weights`` are the hashed feature weights of label 1 against label 0, ``moves`` the
    log potentials of label pairs (00, 01, 10, 11), ``bias`` that of label 1.
    """

    bits: int = 20
    weights: np.ndarray | None = None
    bias: float = -4.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros(4))
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if self.weights is None:
            self.weights = np.zeros(1 << self.bits, np.float32)

    def slots(self, token: str) -> list[int]:
        return [k & ((1 << self.bits) - 1) for k in feature_keys(token)]

    def emission(self, tokens: list[str]) -> np.ndarray:
        """Log odds of label 1 from the tokens alone; weights of known tokens are kept."""
        known = self.known
        if len(known) > CACHE_TOKENS:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = float(self.weights[self.slots(t)].sum())
        return np.fromiter((known[t] for t in tokens), np.float64, len(tokens)) + self.bias

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def chain_odds(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of label 1 against 0 for chains laid end to end.

    The forward odds include the token's own emission.  All chains advance together, one
    position a step, longest chains first, so a step is a few vector operations.
    """
    m00, m01, m10, m11 = np.exp(moves)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    w = np.exp(np.clip(emission, -60, 60))
    ahead, back = np.empty_like(w), np.ones_like(w)
    longest = int(sizes[0]) if len(sizes) else 0
    # Chains that reach position t: sizes are descending.
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")
    r = w[starts[: alive[0]]] if longest else w[:0]
    if longest:
        ahead[starts[: alive[0]]] = r
    for t in range(1, longest):
        n = alive[t]
        at, r = starts[:n] + t, r[:n]
        r = np.clip(w[at] * (m01 + m11 * r) / (m00 + m10 * r), 1e-60, 1e60)
        ahead[at] = r
    ends = starts + sizes - 1
    s = np.ones(len(sizes))
    for t in range(1, longest):
        n = alive[t]
        at = ends[:n] - t
        x = w[at + 1] * s[:n]
        s = np.clip((m10 + m11 * x) / (m00 + m01 * x), 1e-60, 1e60)
        back[at] = s
    return ahead, back


def marginals(crf: Crf, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of label 1 for every token, by forward-backward over whole chains."""
    ahead, back = chain_odds(emission, lengths, crf.moves)
    odds = ahead * back
    return odds / (1 + odds)


def feature_keys(token: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "replace")) for f in features_of(token)]


def unlike(word: np.ndarray, doc: np.ndarray, docs: int, shingle: int = 5, most: float = 0.3) -> np.ndarray:
    """Which documents are no near copies of earlier ones of the sample: copies repeat their
    words together, which would pass for evidence about each word."""
    n = len(word) - shingle + 1
    if n <= 0:
        return np.ones(docs, bool)
    value = np.zeros(n, np.uint64)
    for j in range(shingle):
        value = value * np.uint64(0x9E3779B97F4A7C15) + word[j : j + n].astype(np.uint64) + np.uint64(1)
    inside = doc[:n] == doc[shingle - 1 :]
    value, of = value[inside], doc[:n][inside]
    order = np.lexsort((of, value))
    value, of = value[order], of[order]
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    first = np.repeat(of[starts], np.diff(np.r_[starts, len(value)]))
    early = np.bincount(of[first < of], minlength=docs)
    return early <= most * np.bincount(of, minlength=docs)


def marking_features(
    doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray, purity: float = 0.9, surprise: float = 8.0
) -> np.ndarray:
    """Features that mark a token as toxic, from distinct pairs of a document and a feature.

    Nearly all documents with the feature are toxic, and more than chance explains: the
    log probability of so many toxic ones among its documents, at the share of toxic
    documents, lies below that of one in all features by ``surprise``.
    """
    names, at = np.unique(feature, return_inverse=True)
    n = np.bincount(at, minlength=len(names)).astype(float)
    k = np.bincount(at, toxic[doc].astype(float), len(names))
    share, q = toxic.mean(), k / n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n * (np.where(k > 0, q * np.log(q / share), 0) + np.where(k < n, (1 - q) * np.log((1 - q) / (1 - share)), 0))
    return names[(q >= purity) & (gain >= np.log(len(names)) + surprise)]


def fit(
    texts: list[str], toxic: list[int], bits: int = 20, rounds: int = 60, rate: float = 0.5,
    decay: float = 1e-6,
) -> Crf:
    """Train on documents with a label: its marked tokens are the labelled tokens.

    Adagrad on the log likelihood of the label sequences; chains are cut to 256 tokens for
    training only.  Without both labels the field stays at its start, and finds nothing.
    """
    crf = Crf(bits)
    names: dict[str, int] = {}
    ids = [np.array([names.setdefault(t, len(names)) for t in tokens_of(text)], np.int64) for text in texts]
    word, doc = np.concatenate([np.zeros(0, np.int64), *ids]), np.repeat(np.arange(len(ids)), [len(d) for d in ids])
    kept = np.flatnonzero(unlike(word, doc, len(ids)))
    ids, toxic = [ids[i] for i in kept if len(ids[i])], np.array([toxic[i] for i in kept if len(ids[i])], bool)
    if not toxic.any() or toxic.all():
        return crf
    word, doc = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(d) for d in ids])
    keys = [feature_keys(t) for t in names]
    key = np.array([k for ks in keys for k in ks], np.int64)
    owner = np.repeat(np.arange(len(names)), [len(ks) for ks in keys])
    # Distinct pairs of a document and a word, then of a document and a feature.  A stem's
    # evidence is that of its words but the most frequent one, which speaks for itself.
    pairs = np.unique(doc * len(names) + word)
    pair_doc, pair_word = pairs // len(names), pairs % len(names)
    whole = np.zeros(len(key), bool)
    whole[np.searchsorted(owner, np.arange(len(names)))] = True
    frequent = np.bincount(pair_word, minlength=len(names))[owner]
    order = np.lexsort((-frequent, key))
    top = np.zeros(len(key), bool)
    top[order[np.r_[True, key[order][1:] != key[order][:-1]]]] = True
    spoken = np.flatnonzero(whole | ~top)
    starts, ends = (np.searchsorted(owner[spoken], np.arange(len(names)), side=x) for x in ("left", "right"))
    many = (ends - starts)[pair_word]
    at = spoken[np.repeat(starts[pair_word] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    found = np.unique(np.repeat(pair_doc, many) << 32 | key[at])
    marks = marking_features(found >> 32, found & 0xFFFFFFFF, toxic)
    # Stems that mark nothing are no features.
    useful = whole | np.isin(key, marks)
    key, owner = key[useful], owner[useful]
    marked = np.bincount(owner, np.isin(key, marks), len(names)) > 0
    y = marked[word] & toxic[doc]
    lengths = np.concatenate([[min(256, len(d) - i) for i in range(0, len(d), 256)] for d in ids]).astype(np.int64)
    del pairs, pair_doc, pair_word, many, at, found, frequent, order, ids, doc, names
    flat, words = key & ((1 << bits) - 1), len(keys)
    first = np.zeros(len(word), bool)
    first[np.cumsum(lengths) - lengths] = True
    inner = np.flatnonzero(~first)
    seen = np.bincount(2 * y[inner - 1] + y[inner], minlength=4).astype(float)
    moves = np.zeros(4)
    sums, move_sums, bias_sum = np.zeros(1 << bits), np.zeros(4), 0.0
    weights = np.zeros(1 << bits)
    scale = max(1, int(y.sum()))
    for _ in range(rounds):
        of_word = np.bincount(owner, weights[flat], words)
        e = of_word[word] + crf.bias
        ahead, back = chain_odds(e, lengths, moves)
        odds = ahead * back
        p = odds / (1 + odds)
        pull = y - p
        g = np.bincount(flat, np.bincount(word, pull, words)[owner], 1 << bits) / scale - decay * weights
        # Expected label pairs, from the odds of the four pairs at each inner position.
        before, x = ahead[inner - 1], np.exp(np.clip(e[inner], -60, 60)) * back[inner]
        m = np.exp(moves)
        total = m[0] + m[1] * x + m[2] * before + m[3] * before * x
        want = m * [np.sum(1 / total), np.sum(x / total), np.sum(before / total), np.sum(before * x / total)]
        gm, gb = (seen - want) / scale, pull.sum() / scale
        sums += g * g
        move_sums += gm * gm
        bias_sum += gb * gb
        weights += rate * g / np.sqrt(sums + 1e-12)
        moves += 0.2 * rate * gm / np.sqrt(move_sums + 1e-12)
        crf.bias += 0.2 * rate * gb / np.sqrt(bias_sum + 1e-12)
        moves -= moves.max()
    crf.weights, crf.moves = weights.astype(np.float32), moves
    return crf


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(id as text) leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", most: int = 2500,
) -> DataFrame:
    """``text, y`` to learn from: at most ``most`` texts of either label.

    Never a held-out row or a null label; an id with several labels counts as toxic if one
    says so.  Which rows are taken is decided by a digest of their text.
    """
    known = (
        labels.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("key"))
        .agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("y"))
    )
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # Digests and ids alone are ranked; the chosen texts are fetched afterwards.
    digests = rows.select("id", F.xxhash64("text").alias("h")).join(known, F.col("id") == F.col("key"))
    clean, toxic = (digests.filter(F.col("y") == y).orderBy("h", "id").limit(most) for y in (0, 1))
    chosen = clean.unionByName(toxic).select("key", "h", "y").distinct()
    found = rows.join(F.broadcast(chosen), (F.col("id") == F.col("key")) & (F.xxhash64("text") == F.col("h")))
    return found.select("text", "y").distinct()


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", most: int = 2500,
) -> Crf:
    """The field learnt from ``training_rows``, a bounded sample, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())})
        crf = fit([t for t, _ in rows], [y for _, y in rows])
        yield pa.RecordBatch.from_pylist([{"weights": crf.weights.tobytes(), "moves": crf.moves.tolist(), "bias": crf.bias}])

    sample = training_rows(docs, labels, id_col, text_col, label_col, most)
    model = sample.repartition(1).mapInArrow(run, "weights binary, moves array<double>, bias double").first()
    if model is None:  # nothing to learn from
        return Crf()
    weights = np.frombuffer(model["weights"], np.float32)
    return Crf(len(weights).bit_length() - 1, weights, model["bias"], np.array(model["moves"]))


def _tagged(crf: Crf, spans: bool, least: float):
    schema = [("id", None), ("score", pa.float64())]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])
    if spans:
        schema.append(("spans", pa.list_(span)))

    def spans_of(text: str, p: np.ndarray) -> list[dict]:
        if not len(p) or p.max() < least:
            return []
        found, last = [], -2
        for i, m in enumerate(TOKEN.finditer(lowered(text))):
            if p[i] >= least:
                if found and last == i - 1:
                    found[-1]["end"] = m.end()
                    found[-1]["probability"] = max(found[-1]["probability"], float(p[i]))
                else:
                    found.append({"start": m.start(), "end": m.end(), "probability": float(p[i])})
                last = i
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            score, found = np.zeros(len(texts)), [[] for _ in texts]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            for a, b in in_chunks((len(texts[i]) // 5 + 1 for i in order), CHUNK_TOKENS):
                part = order[a:b]
                docs = [tokens_of(texts[i]) for i in part]
                lengths = np.array([len(d) for d in docs], np.int64)
                full = np.flatnonzero(lengths)
                if not len(full):
                    continue
                e = crf.emission([t for d in docs for t in d])
                p = marginals(crf, e, lengths[full])
                ends = np.cumsum(lengths[full])
                score[[part[k] for k in full]] = np.maximum.reduceat(p, ends - lengths[full])
                if spans:
                    for k, end in zip(full.tolist(), ends.tolist()):
                        found[part[k]] = spans_of(texts[part[k]], p[end - lengths[k] : end])
            columns = [batch.column(0), pa.array(score)]
            if spans:
                columns.append(pa.array(found, type=pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in schema])

    return run


def score_documents(
    docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text",
    spans: bool = True, least: float = THRESHOLD,
) -> DataFrame:
    """``id, score`` and ``spans`` (start, end, probability) per row, over whole texts.

    The score is the greatest marginal of a token; spans are runs of tokens whose marginal
    is ``least`` or more, with offsets in characters.  Empty and null texts and texts
    without tokens score 0 and have no spans.  Repeated rows stay repeated.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double"
    if spans:
        schema += ", spans array<struct<start:int,end:int,probability:double>>"
    return rows.mapInArrow(_tagged(crf, spans, least), schema)


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    crf = train(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _tagged(crf, False, threshold)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).fill_null("")
            ids = pa.array(np.arange(batch.num_rows))
            for scored in score(iter([pa.RecordBatch.from_arrays([ids, texts], names=["id", "text"])])):
                yield batch.filter(pc.less(scored.column(1), threshold))

    return docs.mapInArrow(run, docs.schema)
