"""Encoding by forced boundaries against another library's encoder and against plain merging."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortlake.llm import bpe
from cohortlake.llm.queries import QUERIES, WORD_VOCABULARY

TEXTS = [
    "The quick brown fox's jumps over the lazy dog, doesn't it? I'll say we've 1234 5!",
    "Straße ΣΊΣΥΦΟΣ İstanbul ÅNGSTRÖM étude ﬁne",
    "日本語のテキスト 한국어 русский текст العربية हिन्दी",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|endoftext| >",
    "a</w>b </w> x</W>y <w>",
    "tab\tline\nvt\x0bff\x0ccr\rfs\x1c nel\x85 nbsp\xa0 ogham  zwsp​ ideo　 mvs᠎",
    "\x00\x01 nul\x00end \x7f",
    "👍🏽👩‍👩‍👧 emoji🎉🎉🎉🎉",
    "''''s's't're\"\"\"...!!!???----====",
    " ",
    "",
    "x",
    "ab" * 3000,
    "z" * 5000 + "'s" * 100,
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(Path(WORD_VOCABULARY).read_bytes())


@pytest.fixture(scope="module")
def other():
    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def some_texts(rng, n):
    alphabets = [
        "etaoinshrdlu '",
        "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,'\"-\n\t",
        "äöüßéèñçœæøåÄÖÜÉ aeí̈",
        "αβγδεζσςΣΑΩ абвгдеёЖЗИ 你好世界日本 한글 عربي",
        "".join(map(chr, range(1, 0x250))),
        "<|endoftext|> <|startoftext|>",
    ]
    for _ in range(n):
        yield "".join(rng.choices(rng.choice(alphabets), k=rng.randrange(1, 80)))


def test_ids_equal_the_librarys(vocabulary, other):
    for text in [*TEXTS, *some_texts(random.Random(1), 3000)]:
        assert vocabulary.encode([text])[0].tolist() == other.encode(text, add_special_tokens=False).ids, ascii(text)


def test_all_letters(vocabulary, other):
    """Every character in context: classes, lower case, normal form."""
    starts = [*range(0, 0x3400, 64), *range(0xA000, 0xD800, 64), *range(0xF900, 0x1F000, 64), *range(0x323B0, 0x33600, 64)]
    for start in starts:
        text = "".join(f"a{chr(c)}b {chr(c)} " for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        ours, theirs = vocabulary.encode([text])[0].tolist(), other.encode(text, add_special_tokens=False).ids
        assert ours == theirs, hex(start)


def plain_merging(vocabulary, word):
    """The pair of least rank first, of equal ones the leftmost, without any cut."""
    merges = {int(k): (int(r), int(m)) for k, r, m in zip(vocabulary.keys, vocabulary.ranks, vocabulary.made)}
    token = [int(vocabulary.symbols[b + 256 * (i == len(word) - 1)]) for i, b in enumerate(word)]
    while True:
        found = [(merges[a << 32 | b], i) for i, (a, b) in enumerate(zip(token, token[1:])) if a << 32 | b in merges]
        if not found:
            return token
        (_, made), i = min(found, key=lambda f: (f[0][0], f[1]))
        token[i : i + 2] = [made]


def test_cuts_are_certain(vocabulary):
    """Fragments encoded apart give the tokens of the whole word merged at once."""
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdluqxzjk'-é日", k=rng.randrange(1, 30))) for _ in range(200)]
    cut = 0
    tokens, counts = vocabulary.words_ids(words)
    for word, ids in zip(words, np.split(tokens, np.cumsum(counts)[:-1])):
        data = word.encode()
        symbols = np.array([*data[:-1], data[-1] + 256])
        cut += len(vocabulary.cuts(symbols, np.array([0]))) > 1
        whole, _ = vocabulary.merged(symbols, np.array([0]))
        assert list(ids) == whole.tolist() == plain_merging(vocabulary, data)
    assert cut > 50


def test_one_long_word(vocabulary, other):
    for word in ("a" * 100_001, "ha" * 50_000, "!" * 70_001):
        assert vocabulary.encode([word])[0].tolist() == other.encode(word, add_special_tokens=False).ids


def test_words_are_forgotten(vocabulary, other, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    for text in TEXTS * 2:
        assert vocabulary.encode([text])[0].tolist() == other.encode(text, add_special_tokens=False).ids


def test_query(spark, tmp_path, other):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *some_texts(random.Random(3), 200)])]
    rows += [(500, None), (None, "no id"), (0, TEXTS[0]), (0, TEXTS[0])]
    kind = "doc_id bigint, text string, n_tokens string, token_ids string, plain_text int"
    spark.createDataFrame([(*r, "x", "y", 1) for r in rows], kind).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in QUERIES["op11_bpe_round_trip"](spark, str(tmp_path)).collect())))
    want = []
    for ident, text in rows:
        ids = other.encode(text or "", add_special_tokens=False).ids
        numbers = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        back = hashlib.sha256(other.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want.append(str((ident, len(ids), numbers, back)))
    assert got == sorted(want)


def test_round_trip_of_frames(spark):
    df = spark.createDataFrame([(1, "Hello  World", "kept"), (2, None, None)], "a int, text string, plain_text string")
    got = bpe.decode(bpe.encode(df, WORD_VOCABULARY), WORD_VOCABULARY)
    assert got.columns == ["a", "text", "plain_text", "token_ids", "decoded"]
    assert df.columns == ["a", "text", "plain_text"]
    rows = {r.a: r for r in got.collect()}
    assert rows[1].decoded == "hello</w> world</w>" and rows[1].plain_text == "kept" and rows[1].text == "Hello  World"
    assert rows[2].decoded == "" and rows[2].token_ids == [] and rows[2].text is None
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("token_ids", df.a), WORD_VOCABULARY)


def test_decode_skips_what_is_no_token(spark):
    df = spark.createDataFrame([(1, [320, None, 10**6, -1, 49407]), (2, None)], "a int, token_ids array<int>")
    rows = {r.a: r.decoded for r in bpe.decode(df, WORD_VOCABULARY).collect()}
    assert rows == {1: "a</w> <|endoftext|>", 2: ""}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.token_digests(df, WORD_VOCABULARY).collect() == []
