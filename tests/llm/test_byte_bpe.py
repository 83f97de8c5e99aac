"""Byte-level BPE against the tokenizers library: ids, and the text that they give back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stepframe.llm import byte_bpe
from stepframe.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def own():
    return byte_bpe.ByteBpe(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def agree(own, library, texts):
    flat, bounds = own.encode(texts)
    back = own.decode(flat, bounds)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert flat[bounds[i] : bounds[i + 1]].tolist() == want, t
        assert back[i] == library.decode(want, skip_special_tokens=False), t


def test_every_character(own, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    agree(own, library, ["x" + "".join(every[i : i + 700]) + " y" for i in range(0, len(every), 700)])


ALPHABETS = {
    "letters": "abcdeth  inrsou'.\n", "blanks": "ab1.,'s \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ᠎  ​   　﻿",
    "runs": "aab  \n", "contractions": "'sdtmlrev I", "marks": "<|endoftext|> x", "scripts": "aéß日本語 😀́٣௧१ 12",
}


@pytest.mark.parametrize("name", ALPHABETS)
def test_random_texts(own, library, name):
    r = random.Random(name)
    agree(own, library, ["".join(r.choice(ALPHABETS[name]) for _ in range(r.randint(0, 50))) for _ in range(2000)])


def test_special_and_long_texts(own, library):
    end = "<|endoftext|>"
    agree(own, library, [None, "", end, f" {end} ", f"a{end}{end}\n\n b", "a" * 30_000, " " * 5000, "ab" * 20_000 + "\n" * 300 + "é" * 3000, "x  " + end[:-1]])


def test_tokens_are_proposed_only_if_merges_make_them(own):
    spelled = own.spelled
    for i in own.tokens[::97].tolist():
        word = spelled.join(own.tokens[own.tokens == i])
        assert own.merge(word) == [i]


def test_failing_words_only_are_merged(own):
    r = random.Random(5)
    words = ["".join(r.choice("anertionshouing") for _ in range(r.randint(1, 12))).encode() for _ in range(3000)]
    proposed, counts = own.propose(words)
    ends = counts.cumsum()
    failing = sum(proposed[e - n : e].tolist() != own.merge(w) for w, e, n in zip(words, ends, counts, strict=True))
    flat, counts = own.words(words)
    ends = counts.cumsum()
    assert all(flat[e - n : e].tolist() == own.merge(w) for w, e, n in zip(words, ends, counts, strict=True))
    assert 0 < failing == own.merged < len(words)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    monkeypatch.setattr(byte_bpe, "KEPT", 20)
    own = byte_bpe.ByteBpe(tokenizer_path("byte_bpe_50k.json"))
    r = random.Random(6)
    for _ in range(10):
        agree(own, library, [" ".join("".join(r.choice("aeiou") for _ in range(4)) for _ in range(30)) for _ in range(5)])


def test_rows(spark, library):
    rows = [(None, "null id", "a", "b"), (1, None, None, None), (2, "", "a", "b"), (3, "two  words\n", "a", "b"), (3, "two  words\n", "a", "b"), (4, "x\x00 😀", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    made = byte_bpe.encode_texts(docs, decoded="decoded")
    got = made.collect()
    assert made.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in got)
    again = byte_bpe.decode_ids(made.drop("decoded"))
    assert sorted((r.doc_id or 0, r.decoded) for r in again.collect()) == sorted((r[0] or 0, r[1] or "") for r in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 72, 99_999, -5, 73])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in byte_bpe.decode_ids(odd).collect()} == {1: "", 2: "", 3: library.decode([72, 73])}
    assert byte_bpe.encode_texts(docs.limit(0)).collect() == []


def test_query_digests(spark, library, tmp_path):
    spark.createDataFrame([(1, "the tokens of a text"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in byte_bpe.op12_byte_bpe(spark, str(tmp_path)).collect()}
    ids = library.encode("the tokens of a text", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_tokens, got[1].ids_sha256, got[1].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha("the tokens of a text"))
    assert (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256) == (0, sha(""), sha(""))
    assert byte_bpe.op12_byte_bpe(spark, str(tmp_path)).where(F.col("n_tokens") > 0).count() == 1
