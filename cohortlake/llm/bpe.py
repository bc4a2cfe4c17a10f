"""Byte-pair encoding with forced boundaries, and its decoding.

A merge joins two neighbouring symbols into one token, so two bytes that stand side by side
inside no token of the vocabulary are never joined: between them is a certain cut.  A word
is split at its certain cuts, the fragments are encoded each for itself, and their ids are
put end to end.  Fragments are short and few, also where words are long or new.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cohortlake.llm.common import fresh, in_chunks, text_or_empty, utf8

# The characters with the property White_Space, which \s stands for in vocabulary files.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NO_SPACE = regex.compile(f"[^{SPACES}]+")
# Separators that Python's split() takes for white space.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
# How the vocabulary files that are read here normalise texts and cut them to words.
NORMAL_FORM = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENS = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# Ranges of code points that became letters or numbers after Unicode 16, whose
# classes vocabulary files count on.  The tables at hand are newer.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D,
    0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1,
    0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475,
    0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123,
    0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0,
    0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
# Pairs of small letters (first, last, distance) that the tables for lower
# case at hand are too old for.
LOWER = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
# Bytes of text encoded at a time; runs that a worker remembers (besides those of the last chunk).
CHUNK_BYTES = 1 << 20
REMEMBERED = 1 << 19


def _set(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_LOWER = {c: c + by for a, b, by in LOWER for c in range(a, b + 1)}
_ANY_LOWER = regex.compile(f"[{_set(tuple((a, b) for a, b, _ in LOWER))}]")


def lower(text: str) -> str:
    """Lower case letter by letter, without the final form of sigma."""
    if text.isascii():
        return text.lower()
    if _ANY_LOWER.search(text):
        text = text.translate(_LOWER)
    return text.replace("Σ", "σ").lower()


def byte_letters() -> dict[str, int]:
    """The letter that stands for a byte in vocabulary files: printable Latin-1 characters
    stand for themselves, the other bytes in order for the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class _Spellings:
    """What ids stand for, to be written out joined by a space; None for ids of nothing."""

    def __init__(self, spelled: list[str | None]):
        data = [b"" if s is None else s.encode() + b" " for s in spelled]
        self.sizes = np.array([len(d) for d in data])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def written(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of lists of ids that lie end to end, and where each list's begin and end."""
        ids = ids.astype(np.int64)
        real = (ids >= 0) & (ids < len(self.sizes))
        ids = np.where(real, ids, 0)
        sizes = np.where(real, self.sizes[ids], 0)
        per_list = np.diff(np.r_[0, np.cumsum(sizes)][np.cumsum(np.r_[0, counts])])
        begins = np.where(real, self.begins[ids], 0)
        data = self.data[_ranges(begins, sizes)]
        past = np.cumsum(per_list)
        keep = np.ones(len(data), bool)
        keep[past[per_list > 0] - 1] = False  # the last space of every list
        return data[keep], np.r_[0, np.cumsum(per_list - (per_list > 0))]


class Vocabulary:
    """A vocabulary file (JSON) of byte-pair merges with an end-of-word mark."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        if model.get("type") != "BPE" or not suffix or model.get("continuing_subword_prefix"):
            raise ValueError("not a vocabulary of byte pairs with an end-of-word mark")
        ids = model["vocab"]
        tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.tokens = _Spellings([tokens.get(i) for i in range(max(tokens) + 1)])
        self.numbers = _Spellings([str(i) for i in range(max(tokens) + 1)])
        # Symbols: a byte inside a word, or (256 more) at its end.
        letters = byte_letters()
        self.symbols = np.zeros(512, np.int64)
        for letter, byte in letters.items():
            self.symbols[byte], self.symbols[byte + 256] = ids[letter], ids[letter + suffix]
        self._set_merges(model["merges"], ids)
        self._set_texts(spec)
        self._forget()

    def _set_texts(self, spec: dict) -> None:
        """How texts are cut: special tokens, normal form, pre-tokens."""
        added = [t for t in spec["added_tokens"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens must stand for themselves")
        self.special = {t["content"]: t["id"] for t in added}
        longest = sorted(self.special, key=len, reverse=True)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        if spec["normalizer"] != NORMAL_FORM or spec["pre_tokenizer"] != PRE_TOKENS:
            raise ValueError("texts must be normalised and cut as by NORMAL_FORM and PRE_TOKENS")
        pattern = PRE_TOKENS["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACES)
        self.pre_tokens = regex.compile(pattern)
        self.rare = regex.compile(f"[{_set(LATER)}]")
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{_set(LATER)}]]")
        self.rare_pre_tokens = regex.compile(pattern, regex.V1)

    def _set_merges(self, merges: list, ids: dict[str, int]) -> None:
        """Pairs of tokens as sorted keys, with their ranks and what they become."""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in merges]
        left, right, made = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs)))
        order = np.argsort(left << 32 | right)
        self.keys, self.ranks, self.made = (left << 32 | right)[order], order, made[order]
        # Ranks may be taken one after the other if no token is made before its parts, nor twice.
        born = np.full(max(ids.values()) + 1, -1)
        born[made] = np.arange(len(made))
        rank = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (born[left] >= rank).any() or (born[right] >= rank).any():
            raise ValueError("merges must come after those that make their parts, and make a token once")
        # The pairs inside a token are those inside its parts and the one where the parts
        # meet, so the pairs inside tokens are those where the parts of a merge meet.
        first, last = np.zeros((2, len(born)), np.int64)
        first[self.symbols] = last[self.symbols] = np.arange(512)
        self.joined = np.zeros((512, 512), bool)
        for a, b, c in zip(left.tolist(), right.tolist(), made.tolist()):
            first[c], last[c] = first[a], last[b]
            self.joined[last[a], first[b]] = True

    def _merge_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in ``keys`` of pairs of tokens; -1 for those that are never merged."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def cuts(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where fragments start in words that lie end to end: at their starts and certain cuts."""
        new = np.r_[True, ~self.joined[symbols[:-1], symbols[1:]]]
        new[starts] = True
        return np.flatnonzero(new)

    def merged(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of fragments that lie end to end, and the place of the first symbol of each.

        In every round the pair of least rank of each fragment is merged wherever it occurs
        in it, from left to right; no new pair can come before it (see ``_set_merges``).
        """
        token, place = self.symbols[symbols], np.arange(len(symbols))
        fragment = np.zeros(len(symbols), np.int64)
        fragment[starts[1:]] = 1
        fragment = np.cumsum(fragment)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        never = len(self.keys)
        at = self._merge_at(token[:-1], token[1:])
        at[fragment[1:] != fragment[:-1]] = -1
        at = np.r_[at, -1]
        while len(token):
            rank = np.where(at >= 0, self.ranks[at], never)
            heads = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(token)])
            active = np.repeat(least < never, sizes)
            if not active.all():  # fragments with nothing to merge are finished
                done.append((place[~active], token[~active]))
                token, place, fragment, at, rank = (x[active] for x in (token, place, fragment, at, rank))
                if not len(token):
                    break
                heads = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
                least, sizes = least[least < never], np.diff(np.r_[heads, len(token)])
            here = np.flatnonzero(rank == np.repeat(least, sizes))
            # In a run of overlapping pairs (of one letter) every second one is merged.
            run = np.flatnonzero(np.r_[True, np.diff(here) != 1])
            here = here[(np.arange(len(here)) - np.repeat(run, np.diff(np.r_[run, len(here)]))) % 2 == 0]
            token[here] = self.made[at[here]]
            keep = np.ones(len(token), bool)
            keep[here + 1] = False
            touched = np.zeros(len(token), bool)
            touched[here] = True
            token, place, fragment, at, touched = (x[keep] for x in (token, place, fragment, at, touched))
            # Only pairs with a new token change.
            again = np.flatnonzero(touched | np.r_[touched[1:], False])
            again = again[again < len(token) - 1]
            at[again] = np.where(
                fragment[again] == fragment[again + 1], self._merge_at(token[again], token[again + 1]), -1
            )
            at[-1] = -1
        if not done:
            return token, place
        place, token = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return token[order], place[order]

    def words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, from their fragments, end to end, and how many each word has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spelled = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(w) for w in spelled])
        symbols = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        token, place = self.merged(symbols, self.cuts(symbols, np.r_[0, ends[:-1]]))
        return token, np.diff(np.searchsorted(place, ends), prepend=0)

    def _pre_tokens(self, run: str) -> list[str]:
        run = lower(run)
        usual = run.isascii() or not self.rare.search(run)
        return (self.pre_tokens if usual else self.rare_pre_tokens).findall(run)

    def _learn(self, runs: list[str]) -> None:
        """Remember the tokens of runs without white space."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = list(set(runs).difference(self.known))
        words = [self._pre_tokens(r) for r in new]
        sizes = np.array([len(w) for w in words], np.int64)
        distinct = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        tokens, counts = self.words_ids(list(distinct))
        of = np.fromiter(map(distinct.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
        self.tokens_of = np.r_[self.tokens_of, tokens[_ranges(np.cumsum(counts)[of] - counts[of], counts[of])]]
        per_run = np.diff(np.r_[0, np.cumsum(counts[of])][np.cumsum(np.r_[0, sizes])])
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(per_run)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens_of, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _runs(self, text: str) -> list[str]:
        """The runs of a text without white space: no pre-token reaches over any."""
        text = unicodedata.normalize("NFC", text)
        return NO_SPACE.findall(text) if SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the texts end to end, and how many each has."""
        runs, sizes, special = [], [], []  # special tokens: place among the runs, id
        for text in texts:
            begin = len(runs)
            if any(s in text for s in self.special):
                for i, x in enumerate(self.at_special.split(text)):
                    if i % 2:
                        special.append((len(runs), self.special[x]))
                        runs.append("")
                    else:
                        runs += self._runs(x)
            else:
                runs += self._runs(text)
            sizes.append(len(runs) - begin)
        self._learn(runs)
        at = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
        begins, counts = self.ends[at], self.ends[at + 1] - self.ends[at]
        known = self.tokens_of
        if special:  # they stand at the end of what is known
            place, ids = (np.array(x, np.int64) for x in zip(*special))
            begins[place], counts[place] = len(known) + np.arange(len(place)), 1
            known = np.r_[known, ids]
        ids = known[_ranges(begins, counts)]
        return ids.astype(np.int32), np.diff(np.r_[0, np.cumsum(counts)][np.cumsum([0, *sizes])])


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every range, end to end."""
    step = np.repeat(begins - (np.cumsum(counts) - counts), counts)
    return step + np.arange(len(step))


def _sent(docs: DataFrame, path: str):
    """The vocabulary file, read here and sent to the workers, which need no file then."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


_PARSED: dict[bytes, Vocabulary] = {}


def _vocabulary(content: bytes) -> Vocabulary:
    """Parsed once a worker."""
    if content not in _PARSED:
        _PARSED.clear()
        _PARSED[content] = Vocabulary(content)
    return _PARSED[content]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of every whole text in ``ids_col`` (array<int>).

    The vocabulary file at ``path`` also says how texts are normalised and cut to words;
    special tokens written out in a text have their own ids.  Null and empty texts have no
    tokens.  Rows stay in their task: repeated rows stay repeated, an empty table gives an
    empty one, and other columns are kept as they are, also one named like a helper.  A
    column that is named ``ids_col`` already is an error.
    """
    if ids_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {ids_col} already")
    (text,) = fresh(docs, "plain_text")
    sent, names = _sent(docs, path), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for batch in batches:
            sizes = np.diff(utf8(batch.column(len(names)))[1]).tolist()
            for a, b in in_chunks(sizes, CHUNK_BYTES):
                part = batch.slice(a, b - a)
                found, counts = vocabulary.encode(part.column(len(names)).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*names, ids_col])

    kind = StructType([*docs.schema, StructField(ids_col, ArrayType(IntegerType()))])
    return docs.withColumn(text, text_or_empty(text_col)).mapInArrow(run, kind)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the tokens of ``ids_col`` joined by a space in ``text_col``, special tokens
    too.  Null ids and ids of no token are left out; a null or empty list gives the empty
    text.  Rows and other columns stay; a column that is named ``text_col`` already is an
    error."""
    if text_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {text_col} already")
    sent, names = _sent(df, path), df.columns
    (ids,) = fresh(df, "plain_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _vocabulary(sent.value).tokens
        for batch in batches:
            sizes = batch.column(len(names)).value_lengths().to_pylist()
            for a, b in in_chunks(sizes, CHUNK_BYTES // 4):
                part = batch.slice(a, b - a)
                ids = part.column(len(names)).flatten().fill_null(-1).to_numpy()
                data, ends = tokens.written(ids, np.array(sizes[a:b]))
                text = pa.Array.from_buffers(
                    pa.large_string(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
                )
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], text.cast(pa.string())], names=[*names, text_col])

    kind = StructType([*df.schema, StructField(text_col, StringType())])
    empty = F.array().cast("array<int>")
    return df.withColumn(ids, F.coalesce(F.col(ids_col).cast("array<int>"), empty)).mapInArrow(run, kind)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of every text: how many tokens
    ``encode`` gives, and digests of the ids (decimal, joined by a space) and of what
    ``decode`` makes of them, without a column of either.

    Null and empty texts have no tokens and the digests of the empty text.  Repeated rows
    stay repeated, null ids stay; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    sent, names = _sent(docs, path), ["id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digests(spelled: tuple[np.ndarray, np.ndarray]) -> list[str]:
        data, ends = spelled[0].tobytes(), spelled[1].tolist()
        return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for batch in batches:
            sizes = np.diff(utf8(batch.column(1))[1]).tolist()
            for a, b in in_chunks(sizes, CHUNK_BYTES):
                part = batch.slice(a, b - a)
                ids, counts = vocabulary.encode(part.column(1).to_pylist())
                found = [digests(s.written(ids, counts)) for s in (vocabulary.numbers, vocabulary.tokens)]
                columns = [pa.array(counts.astype(np.int64)), *(pa.array(f, pa.string()) for f in found)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    kinds = zip(names[1:], (LongType(), StringType(), StringType()))
    kind = StructType([rows.schema["id"], *(StructField(c, t) for c, t in kinds)])
    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)
