import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from hopledger.llm.queries import PIECES
from hopledger.llm.sentence_pieces import Normaliser, SentencePieces, encode_texts, unfold
from tests.llm.conftest import ODD_ROWS

PATH = public_tokenizers.path(PIECES)
with open(PATH, "rb") as file:
    MODEL = file.read()
RULES = ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"]


def size(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + size(n >> 7)


def spec(rule, dummy=True, squeeze=True):
    """A normaliser of the library with one of its own maps."""
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    return made, made.serialized_normalizer_spec()


def with_spec(message):
    """The public model with another normaliser: a later field takes the place of an earlier one."""
    return MODEL + b"\x1a" + size(len(message)) + message


def texts(n=250, seed=6):
    draw = random.Random(seed)
    alphabets = ["abcdefgh  ", "thé ieß'ñ çou", "0123456789 .,-", "漢字かな \U0001f600\n\r\t ", "aaaa ", "  ▁ ", "ＡＢｱﾊﾟ ﬁ ½ Ⅷ ㍿ é  　​­ Å", "\x00\x01\x7f ab"]
    out = ["".join(draw.choices(draw.choice(alphabets), k=draw.randrange(0, 60))) for _ in range(n)]
    return [*out, "", " ", "   ", "▁", "a", " a ", "<s></s><unk><0x0A>", "가각힣 ﷺ", "x" * 3000, "漢" * 2000, " " * 900 + "y", "ab " * 2000]


def encoded(pieces, text, whole=False):
    normal, origin = pieces.normalise(text)
    ids, spans, at = [], [], 0
    for block in pieces.blocks(normal) if whole else pieces.split([normal, "more"])[:1]:
        if not block:
            continue
        _, _, found, sizes = pieces.look(block)
        ids += found.tolist()
        for n in sizes.tolist():
            spans.append((int(origin[at]), int(origin[at + n])))
            at += n
    return ids, spans


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("squeeze", [True, False])
def test_normalising_records_sources(rule, squeeze):
    for dummy in (True, False):
        library, message = spec(rule, dummy, squeeze)
        own = Normaliser(message)
        for text in texts():
            normal, origin = own(text)
            expected = library.normalize(text)
            assert normal == expected, (text, normal, expected)
            assert origin.size == len(normal.encode()) + 1 and (np.diff(origin) >= 0).all()


def test_unfolded_map_is_the_library_s():
    library, message = spec("nfkc")
    table = Normaliser(message).prefixes
    assert len(table) > 4000
    for key, value in random.Random(1).sample(sorted(table.items()), 400):
        plain = sentencepiece.SentencePieceNormalizer(normalizer_spec=message, add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
        assert plain.normalize(key) == value
    assert unfold(b"") == {}


@pytest.mark.parametrize("model", [MODEL, *(with_spec(spec(*how)[1]) for how in (("nfkc", True, True), ("nmt_nfkc", False, True), ("nmt_nfkc_cf", True, False), ("identity", False, False)))])
def test_ids_spans_and_texts_match_the_library(model):
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), SentencePieces(model)
    for text in texts(150):
        ids, spans = encoded(own, text)
        proto = library.encode(text, return_type="proto")
        assert ids == [p.id for p in proto.pieces], text
        assert spans == [(p.begin, p.end) for p in proto.pieces], text
        assert own.decode(ids) == library.decode(ids)


def test_decoding_of_any_ids():
    library, own = sentencepiece.SentencePieceProcessor(model_proto=MODEL), SentencePieces(MODEL)
    draw = random.Random(2)
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(262), draw.randrange(3), 28705, 259]) for _ in range(draw.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_matrix_and_heap_agree():
    own = SentencePieces(MODEL)
    chunks = sorted({c for t in texts() for c in own.chunk.findall(own.normalise(t)[0]) if len(c) <= 64})
    flat, sizes = own.merge_matrix(chunks)
    strange, text, at = {n: c for c, n in own.strange.items()}, list(own.number), 0
    for chunk, size in zip(chunks, sizes.tolist(), strict=True):
        assert [text[n] if n >= 0 else strange[n] for n in flat[at:at + size].tolist()] == own.merged(chunk)
        at += size


def test_blocks_and_memory(monkeypatch):
    expected = encoded(SentencePieces(MODEL), "some words here and there 漢漢 " * 50)
    monkeypatch.setattr("hopledger.llm.sentence_pieces.BLOCK_CHUNKS", 3)
    monkeypatch.setattr("hopledger.llm.sentence_pieces.CACHE_CHARS", 10)
    assert encoded(SentencePieces(MODEL), "some words here and there 漢漢 " * 50, whole=True) == expected


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="byte fallback"):
        SentencePieces(MODEL + b"\x12\x02\x18\x01")


def test_odd_rows(spark, odd, empty, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rows = encode_texts(odd, PATH, with_ids=True).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(i or -1, sha(library.decode(ids)), sha(",".join(map(str, ids))), ids) for i, t, *_ in ODD_ROWS for ids in [library.encode(t or "")]]
    assert sorted((r.doc_id or -1, r.decoded_sha256, r.ids_sha256, list(r.ids)) for r in rows) == sorted(expected)
    text = {i: (t or "").encode() for i, t, *_ in ODD_ROWS}
    for r in rows:
        assert r.n_tokens == len(r.ids) == len(r.begins) == len(r.ends)
        assert b"".join(text[r.doc_id][a:b] for a, b in zip(r.begins, r.ends, strict=True)) == text[r.doc_id]
        spans = np.array(list(zip(r.begins, r.ends, strict=True)), "<i8").reshape(-1, 2)
        assert r.spans_sha256 == hashlib.sha256(spans.tobytes()).hexdigest()
    assert encode_texts(empty, PATH).count() == 0
