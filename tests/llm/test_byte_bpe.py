import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from hopledger.llm.byte_bpe import BytePairs, encode_texts, read_ranks
from hopledger.llm.queries import VOCABULARY
from tests.llm.conftest import ODD_ROWS

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_ids_match_the_library(library):
    draw = random.Random(4)
    alphabets = ["abcdefgh ", "thé ieß'ñ çou", "0123456789 .,-", "漢字かな \U0001f600\n\r\t ", "aaaa", "'s't're'LL x"]
    texts = ["".join(draw.choices(draw.choice(alphabets), k=draw.randrange(0, 90))) for _ in range(800)]
    texts += ["a" * 700, "ab" * 3000, "é" * 900, "word" * 400, "-" * 1500, " " * 1200 + "x", "\n" * 600]
    found = BytePairs(read_ranks(PATH), public_tokenizers.PATTERN).encode(texts)
    for text, pieces in zip(texts, found, strict=True):
        ids = library.encode_ordinary(text)
        assert ",".join(p[1] for p in pieces) == ",".join(map(str, ids))
        assert sum(p[0] for p in pieces) == len(ids)
        assert b"".join(p[2] for p in pieces).decode() == text


def test_matrix_and_heap_agree():
    pairs = BytePairs(read_ranks(PATH), public_tokenizers.PATTERN)
    pieces = [("thation" * n)[: 3 + n].encode() for n in range(1, 60)] + ["éàü".encode() * 9, b"zzzz" * 16]
    assert pairs.merge_matrix(pieces) == [pairs.merge_long(p) for p in pieces]


def test_memory_of_pieces_is_emptied(monkeypatch):
    monkeypatch.setattr("hopledger.llm.byte_bpe.CACHE_CHARS", 10)
    pairs = BytePairs(read_ranks(PATH), public_tokenizers.PATTERN)
    first = pairs.encode(["some words here"])
    assert pairs.encode(["other"]) and len(pairs.known) == 1
    assert pairs.encode(["some words here"]) == first


def test_odd_rows(odd, empty, library):
    rows = encode_texts(odd, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    expected = sorted(((i or -1, hashlib.sha256((t or "").encode()).hexdigest(), library.encode_ordinary(t or "")) for i, t, *_ in ODD_ROWS))
    assert sorted((r.doc_id or -1, r.decoded_sha256, list(r.ids)) for r in rows) == expected
    assert encode_texts(empty, PATH, public_tokenizers.PATTERN).count() == 0
