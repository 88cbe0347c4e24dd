import hashlib
import random

import pytest
import public_tokenizers
import regex
import tiktoken

from quarry.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_are_merged_as_the_library_does(ranks, library):
    r = random.Random(4)
    pattern = regex.compile(public_tokenizers.PATTERN)
    alphabet = "abcdehst é\n\t1'!.中́\U0001f600\x1c\x85\xa0"
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert [i for w in pattern.findall(text) for i in B.encode_word(w.encode(), ranks)] == library.encode_ordinary(text)
    for text in ("a" * 3000, "hello" * 700, "!" * 999, "<|endoftext|>"):
        assert [i for w in pattern.findall(text) for i in B.encode_word(w.encode(), ranks)] == library.encode_ordinary(text)


def test_round_trip(docs, rows, library, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES_WITH_IDS", 20_000)
    monkeypatch.setattr(B, "LONG_TEXT", 10_000)
    got = {r.doc_id: r for r in B.byte_bpe(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        r = got[i]
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_edges(odd, empty):
    assert B.byte_bpe(empty, PATH, public_tokenizers.PATTERN).count() == 0
    got = sorted((str(r.doc_id), r.n_tokens > 0) for r in B.byte_bpe(odd, PATH, public_tokenizers.PATTERN).collect())
    assert got == [("1", True), ("1", True), ("2", False), ("3", True), ("None", False), ("None", True)]
