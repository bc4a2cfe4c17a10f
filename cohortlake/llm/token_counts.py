"""Token counts of a unigram vocabulary, worked out once per shared prefix in a trie."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import in_chunks

SPACE_MARK = "▁"
# Pre-tokens: runs of characters other than ASCII white space.
PRETOKEN = re.compile(r"[^\x20\x09-\x0D]+")
# Nodes of a trie before it is begun anew, and pre-tokens looked up at a time.
MOST_NODES = 400_000
CHUNK_CHARS = 8_000_000
# Longer pre-tokens (a binary blob, a run of one letter) are worked out without the trie.
LONGEST = 64


@dataclass
class Unigram:
    """Pieces with log scores; a character that no piece covers is spelled in UTF-8 bytes,
    one token each, at a score below that of every piece."""

    scores: dict[str, float]
    mark: str = SPACE_MARK
    unknown: float = field(init=False)
    # Every end of a piece, with the score of the piece that it is, else minus infinity.
    ends: dict[str, float] = field(init=False, repr=False)

    def __post_init__(self):
        self.unknown = min(self.scores.values(), default=0.0) - 10.0
        self.ends = {p[i:]: -math.inf for p in self.scores for i in range(len(p))} | self.scores

    def states(self, text: str) -> list[tuple[float, int]]:
        """The best (score, -tokens) of every prefix of ``text``, the empty one first."""
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            best.append(self.extend(text, end, best))
        return best

    def extend(self, text: str, end: int, best: list[tuple[float, int]]) -> tuple[float, int]:
        """The forward step: the best way to end a token at ``end``, given the best of all
        shorter prefixes.  Of equal scores the fewer tokens win.

        Starts are tried from the last one back: where no piece ends in the characters so
        far, none ends in more of them."""
        score, tokens = best[end - 1]
        spelled = len(text[end - 1].encode("utf-8", "surrogatepass"))
        top, most = score + self.unknown * spelled, tokens - spelled
        known = self.ends.get
        for start in range(end - 1, -1, -1):
            own = known(text[start:end])
            if own is None:
                break
            score, tokens = best[start]
            score += own
            if score > top or score == top and tokens - 1 > most:
                top, most = score, tokens - 1
        return top, most


def sentencepiece_unigram(path: str) -> Unigram:
    """The ordinary pieces of a sentencepiece vocabulary file with their stored scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Unigram({model.id_to_piece(i): model.get_score(i) for i in plain})


class Trie:
    """Pre-tokens by their characters.

    A node holds the forward state of its prefix, worked out when the node is made, so a
    prefix that many pre-tokens share is scored once.  ``counts`` are the terminals.
    """

    def __init__(self, model: Unigram):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.root: dict = {}
        self.counts: dict[str, int] = {}
        self.nodes = 0

    def count(self, pretoken: str) -> int:
        """Number of tokens of one pre-token (its space mark included)."""
        known = self.counts.get(pretoken)
        if known is not None:
            return known
        text = self.model.mark + pretoken
        if len(text) > LONGEST:
            return -self.model.states(text)[-1][1]
        if self.nodes > MOST_NODES:
            self.clear()
        node, best = self.root, [(0.0, 0)]
        for end, char in enumerate(text, 1):
            child = node.get(char)
            if child is None:
                child = node[char] = {None: self.model.extend(text, end, best)}
                self.nodes += 1
            best.append(child[None])
            node = child
        self.counts[pretoken] = tokens = -best[-1][1]
        return tokens


_TRIES: dict[str, Trie] = {}


def _trie(path: str) -> Trie:
    """A worker keeps its trie from one task to the next."""
    if path not in _TRIES:
        _TRIES.clear()
        _TRIES[path] = Trie(sentencepiece_unigram(path))
    return _TRIES[path]


def count_tokens(texts: list[str], trie: Trie) -> tuple[list[int], list[int]]:
    """Pre-tokens and tokens of each text; every distinct pre-token is looked up once."""
    words, tokens = [0] * len(texts), [0] * len(texts)
    for a, b in in_chunks(map(len, texts), CHUNK_CHARS):
        own = [Counter(PRETOKEN.findall(t)) for t in texts[a:b]]
        # In sorted order, neighbours share their prefixes.
        lengths = {w: trie.count(w) for w in sorted(set().union(*own))}
        for i, counts in enumerate(own, a):
            words[i] = counts.total()
            tokens[i] = sum(n * lengths[w] for w, n in counts.items())
    return words, tokens


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_pretokens, n_tokens`` for every row of ``docs``.

    A text's pre-tokens are its runs of characters other than ASCII white space, each with
    a space mark before it; its tokens are those of the best unigram segmentation of each
    (greatest sum of scores, then fewest tokens).  Null, empty and blank texts have none.
    Rows never leave their task: the trie is bounded, and a model file is read by its path,
    which has to exist on every executor.  Repeated rows stay repeated; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model_path)
        for batch in batches:
            words, tokens = count_tokens(["" if t is None else t for t in batch.column(1).to_pylist()], trie)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=["id", "n_pretokens", "n_tokens"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {kind}, n_pretokens bigint, n_tokens bigint")
    return counted.withColumnRenamed("id", id_col)
