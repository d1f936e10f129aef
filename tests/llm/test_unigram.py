import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from stratablock.llm.unigram import MARK, Pieces, UnigramCodec, unigram_codes

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    """The library's own unigram search over the same pieces and scores; it doesn't always find the best sum."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(VOCABULARY, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def texts(n=1500):
    rng = random.Random(6)
    syllables = ["th", "er", "on", "an", "ción", "heit", "eau", "é", "ß", "日", "本", "😀", "1", ".", ",", "\n", "\t", "  ", " ", " ", "\0", "x"]
    fixed = ["", " ", "  ", " a", "a ", "a  b", "\n", "hello world", MARK, "a" + MARK + "b", MARK + " x", " " + MARK, "\0", "\0a b", "a \0b", "x" * 500, "日本" * 200]
    return fixed + ["".join(rng.choice(syllables) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_score_and_round_trip(pieces, library):
    codec = UnigramCodec(pieces, cache_units=200)
    many = texts()
    byte_ids = set(pieces.byte.values())
    for i in range(0, len(many), 64):
        part = many[i : i + 64]
        for text, packed in zip(part, codec.encode(part)):
            assert codec.decode(packed) == text
            ids = np.frombuffer(packed, codec.kind).tolist()
            if MARK in text or "\0" in text:
                continue
            want = library.encode(text)
            # byte pieces stand for unknown characters, of which both have the same
            score = lambda x: sum(pieces.score[k] for k in x if k not in byte_ids)
            assert [k for k in ids if k in byte_ids] == [k for k in want if k in byte_ids]
            assert score(ids) >= score(want)


def test_batch_is_as_alone(pieces):
    codec = UnigramCodec(pieces)
    rng = random.Random(7)
    units = ["".join(rng.choice(["th", "er", "é", "日", "x", "😀", MARK, "q"]) for _ in range(rng.randint(1, 20))).encode() for _ in range(400)]
    assert codec.segment_batch(units) == [codec.segment_alone(u) for u in units]


def best_by_trial(pieces, text):
    """All segmentations of a short text."""
    names = {}
    sp = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            names[sp.id_to_piece(i)] = i

    def all_of(s):
        if not s:
            yield 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in names:
                yield from (pieces.score[names[s[:k]]] + x for x in all_of(s[k:]))
            elif k == 1:
                yield from (pieces.unknown + x for x in all_of(s[1:]))

    return max(all_of(text))


def test_against_all_segmentations(pieces):
    codec = UnigramCodec(pieces)
    for word in ["▁thereon", "▁ciónxé", "▁日", "▁▁▁a", "hello"]:
        ids = np.frombuffer(codec.segment_alone(word.encode()), codec.kind).tolist()
        bytes_ = [k for k in ids if k in set(pieces.byte.values())]
        assert not bytes_
        assert sum(pieces.score[k] for k in ids) == best_by_trial(pieces, word)


def test_frame(documents, pieces):
    rows = [(1, None), (2, ""), (3, "a  b"), (3, "a  b"), (None, "日😀"), (5, "word " * 60_000), (6, "x" * 100_000)]
    out = unigram_codes(documents(rows), VOCABULARY, ids=True).collect()
    assert len(out) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert {r.doc_id: r.n_tokens for r in out}[2] == 0
    assert unigram_codes(documents([]), VOCABULARY).count() == 0
