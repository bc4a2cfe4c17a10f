"""Text quality from a weak-label model of heuristic labellers and a hashed linear scorer."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import text_or_empty

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it with as was on be by this are from at or an "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le les des et en un une du que est pour qui dans par sur au pas plus avec "
    "el la los las y del se por con no una su para es al lo como más o".split()
)
THRESHOLD = 0.5
BITS = 16
SAMPLE = 8_000
CACHE_WORDS = 200_000


def _vote(value: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    """1 within the good range, 0 outside the wider one, -1 (no vote) between."""
    if good[0] <= value <= good[1]:
        return 1
    return -1 if bad[0] <= value <= bad[1] else 0


# Name of a measure, the range that speaks for a text, and the range outside which it speaks
# against.  Word measures need some words, else they do not vote.
LABELLERS = (
    ("symbols", (0.0, 0.01), (0.0, 0.05)),
    ("capitals", (0.002, 0.1), (0.0, 0.25)),
    ("word_length", (4.2, 6.2), (3.4, 7.5)),
    ("distinct_words", (0.6, 0.98), (0.4, 1.0)),
    ("top_word", (0.0, 0.1), (0.0, 0.2)),
    ("function_words", (0.08, 0.5), (0.03, 0.65)),
    ("repeated_lines", (0.0, 0.05), (0.0, 0.25)),
    ("sentence_ends", (0.9, 1.0), (0.6, 1.0)),
)
NEEDS_WORDS = {"distinct_words": 20, "top_word": 20, "function_words": 20, "word_length": 5}


def votes_of(found: dict[str, float], n_words: int) -> list[int]:
    """One vote per labeller; a text without words gets no vote but the last, against it."""
    if not n_words:
        return [-1] * (len(LABELLERS) - 1) + [0]
    return [-1 if n_words < NEEDS_WORDS.get(name, 1) else _vote(found[name], good, bad) for name, good, bad in LABELLERS]


def shape_of(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each, other characters once."""
    out = []
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[:12])


class Features:
    """Votes and hashed features of texts: shares of word shapes, and the measures in steps.

    What a word adds to the measures is worked out once per distinct word.
    """

    def __init__(self, bits: int = BITS):
        self.mask, self.known, self.slots = (1 << bits) - 1, {}, {}

    def slot(self, name: str) -> int:
        found = self.slots.get(name)
        if found is None:
            if len(self.slots) > CACHE_WORDS:
                self.slots.clear()
            found = self.slots[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) & self.mask
        return found

    def word(self, w: str) -> tuple[int, int, int, int, bool]:
        """Slot of the shape, length, symbols (repeated end marks too), capitals, and whether
        it is a function word."""
        core = w.rstrip(".,;:")
        if core.isalpha() and (core.islower() or core[1:].islower() and core[0].isupper()):
            capitals = int(not core.islower())
            shape = ("Aa" if capitals and len(core) > 1 else "a") + (w[-1] if len(core) < len(w) else "")
            return self.slot("s=" + shape), len(w), 0, capitals, core.lower() in FUNCTION_WORDS
        signs = sum(not (c.isalnum() or c in ".,;:'\"-?!()") for c in w)
        signs += max(0, len(w) - len(w.rstrip("!?")) - 1)
        capitals = sum(map(str.isupper, w))
        return (
            self.slot("s=" + shape_of(w)), len(w), signs, capitals, w.strip(".,;:!?").lower() in FUNCTION_WORDS
        )

    def of(self, text: str) -> tuple[list[int], dict[int, float]]:
        """Votes, and value by slot."""
        counts = Counter(text.split())
        n, size = max(1, counts.total()), max(1, len(text))
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        shares: dict[int, float] = {}
        letters = signs = capitals = functions = 0
        for w, c in counts.items():
            own = known.get(w)
            if own is None:
                own = known[w] = self.word(w)
            s, length, sign, capital, function = own
            shares[s] = shares.get(s, 0.0) + c / n
            letters += c * length
            signs += c * sign
            capitals += c * capital
            functions += c * function
        lines = [x for x in (y.strip() for y in text.split("\n")) if x]
        found = {
            "symbols": signs / size,
            "capitals": capitals / size,
            "word_length": letters / n,
            "distinct_words": len(counts) / n,
            "top_word": max(counts.values(), default=0) / n,
            "function_words": functions / n,
            "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
            "sentence_ends": sum(x[-1] in ".!?:;\"'" for x in lines) / len(lines) if lines else 0.0,
        }
        for name, x in found.items():
            step = int(x) if name == "word_length" else int(20 * x)
            shares[self.slot(f"m={name}:{min(step, 20)}")] = 1.0
        shares[self.slot(f"n={min(n, 1 << 20).bit_length()}")] = 1.0
        return votes_of(found, counts.total()), shares


def pattern(votes: list[int]) -> str:
    return "".join("-+"[v] if v >= 0 else "0" for v in votes)


@dataclass
class LabelModel:
    """``prior`` of a good text, and per class and labeller the chances of a vote against and
    for, once it votes; votes are independent given the class.  No vote says nothing: it
    depends on the length of a text, not on its class."""

    prior: float
    chances: np.ndarray  # class, labeller, vote (against, for, none: 1)

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Probability of a good text for each pattern of votes."""
        votes = np.array([["-+0".index(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), -1)
        at = np.arange(self.chances.shape[1])
        logs = [np.log(self.chances[y][at, votes]).sum(axis=1) for y in (0, 1)]
        return 1 / (1 + np.exp(np.clip(np.log((1 - self.prior) / self.prior) + logs[0] - logs[1], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        right = (1 - self.prior) * self.chances[0][:, 0] + self.prior * self.chances[1][:, 1]
        wrong = (1 - self.prior) * self.chances[0][:, 1] + self.prior * self.chances[1][:, 0]
        return right / (right + wrong)


def fit_labels(
    counts: dict[str, int], rounds: int = 200, alarm: float = 0.03, catch: float = 0.5, strength: float = 0.5
) -> LabelModel:
    """Expectation-maximisation over patterns of votes and how many texts have each.

    Labellers are believed beforehand to vote against few good texts (``alarm``) and to
    catch ``catch`` of the bad ones, as if from ``strength`` texts for each one of a class:
    a kind of bad text that only one or two see would otherwise pass for their mistake.
    Starts from the share of votes for a text.  Without texts both votes are as likely.
    """
    size = len(next(iter(counts))) if counts else len(LABELLERS)
    model = LabelModel(0.5, np.tile([0.5, 0.5, 1.0], (2, size, 1)))
    if not counts:
        return model
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([["-+0".index(c) for c in p] for p in patterns])
    ups, downs = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    good = (ups + 1) / (ups + downs + 2)
    onehot = votes[:, :, None] == np.arange(3)
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        belief = np.array([[catch, 1 - catch, 0], [alarm, 1 - alarm, 0]])[:, None, :]
        chances = np.einsum("yp,plv->ylv", weight, onehot)
        chances = chances + belief * (1 + strength * weight.sum(axis=1)[:, None, None])
        chances /= chances[:, :, :2].sum(axis=2, keepdims=True)
        chances[:, :, 2] = 1.0
        model = LabelModel(float(np.clip(weight[1].sum() / n.sum(), 1e-6, 1 - 1e-6)), chances)
        before, good = good, model.posterior(patterns)
        if np.abs(good - before).max() < 1e-9:
            break
    return model


def fit_scorer(rows: list[dict[int, float]], target: np.ndarray, bits: int = BITS, rounds: int = 300, decay: float = 1e-3):
    """Weights and bias of a logistic scorer trained on soft labels (Adagrad, whole batches)."""
    weights, bias = np.zeros(1 << bits), 0.0
    if not rows:
        return weights.astype(np.float32), bias
    slot = np.array([s for r in rows for s in r], np.int64)
    value = np.array([v for r in rows for v in r.values()])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    sums, bias_sum = np.full(1 << bits, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, weights[slot] * value, len(rows)) + bias
        pull = (target - 1 / (1 + np.exp(-np.clip(z, -50, 50)))) / len(rows)
        g = np.bincount(slot, pull[row] * value, 1 << bits) - decay * weights / len(rows)
        gb = pull.sum()
        sums += g * g
        bias_sum += gb * gb
        weights += 0.5 * g / np.sqrt(sums)
        bias += 0.5 * gb / np.sqrt(bias_sum)
    return weights.astype(np.float32), float(bias)


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def vote_counts(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Patterns of votes over all texts; there are 3 ** 8 = 6,561 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(), Counter()
        for batch in batches:
            counts.update(pattern(features.of(t)[0]) for t in batch.column(0).to_pylist())
        if counts:
            columns = [pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["pattern", "n"])

    rows = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "pattern string, n bigint")
    return {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """The label model from the votes on all texts, and the scorer from ``sample`` distinct
    texts chosen by a digest, in one task."""
    labels = fit_labels(vote_counts(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        found = [features.of(t) for t in sorted({t for b in batches for t in b.column(0).to_pylist()})]
        target = labels.posterior([pattern(v) for v, _ in found])
        weights, bias = fit_scorer([f for _, f in found], target)
        yield pa.RecordBatch.from_pylist([{"weights": weights.tobytes(), "bias": bias}])

    texts = docs.select(text_or_empty(text_col).alias("text"))
    digest = F.xxhash64("text").alias("h")
    chosen = texts.select(digest).distinct().orderBy("h").limit(sample)
    rows = texts.join(F.broadcast(chosen), F.xxhash64("text") == F.col("h")).select("text").distinct()
    model = rows.repartition(1).mapInArrow(run, "weights binary, bias double").first()
    if model is None:
        return Scorer(labels, np.zeros(1 << BITS, np.float32), 0.0)
    return Scorer(labels, np.frombuffer(model["weights"], np.float32), model["bias"])


def score_quality(
    docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``id_col, votes, posterior, score, keep, predicted`` for every row of ``docs``.

    ``votes`` has a sign per labeller (+ for the text, - against it, 0 none), ``posterior``
    is the label model's, ``score`` the hashed scorer's; a text is kept at ``threshold`` or
    more.  Null texts count as empty, which only the last labeller votes on, against them.
    Repeated rows stay repeated; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.of(t) for t in batch.column(1).to_pylist()]
            votes = [pattern(v) for v, _ in found]
            z = np.array([sum(scorer.weights[s] * v for s, v in f.items()) for _, f in found]) + scorer.bias
            score = 1 / (1 + np.exp(-np.clip(z.astype(float), -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(votes, pa.string()), pa.array(scorer.labels.posterior(votes)), pa.array(score)],
                names=["id", "votes", "posterior", "score"],
            )

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, votes string, posterior double, score double")
    keep = F.col("score") >= threshold
    return scored.select(
        F.col("id").alias(id_col), "votes", "posterior", "score", keep.alias("keep"), keep.cast("int").alias("predicted")
    )
