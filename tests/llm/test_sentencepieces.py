from __future__ import annotations

import random
import struct

import numpy as np
import pytest

from tests.llm.helpers import clashing, corpus
from waymark.llm import sentencepieces as s

public = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return s.model_bytes(str(PATH))


def texts(seed, n):
    rng = random.Random(seed)
    letters = [chr(c) for c in [*range(32, 127), 9, 10, 13]] + list("éèüñßçабвгде日本語中文한국어🙂𝔘ﬁ▁\u00a0\u3000")
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(n)]
    parts = ["the", "an", "  ", " ", "er", "ing", "\n", "1", "2024", "://", "www.", "=", "==", "日本", "a" * 30, "Ünï", "’s"]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    return out + ["", " ", "   ", "a" * 300, "ab" * 500, "=-" * 200, "日本語" * 100, " " * 100, "x" + " " * 50 + "y", "word " * 3000]


def encoded(encoder, lines):
    memory = s.Remembering(encoder)
    out = []
    for part in (lines[: len(lines) // 2], lines[len(lines) // 2 :]):
        ids, counts = memory.encode([t.encode() for t in part])
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(part) else []
    return out


def test_encoding_equals_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    lines = texts(1, 300)
    assert encoded(s.Encoder(s.Vocabulary.parse(model)), lines) == library.encode(lines)


def test_decoding_equals_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    decoder = s.Decoder(s.Vocabulary.parse(model))
    rng = random.Random(2)
    runs = [[rng.randrange(3, 32000) for _ in range(rng.randint(0, 40))] for _ in range(300)] + library.encode(texts(3, 50))
    ids = np.array([i for r in runs for i in r], np.int64)
    got = decoder.decode(ids, np.array([len(r) for r in runs]))
    want = library.decode(runs)
    assert sum(a == b for a, b in zip(got, want)) >= 0.97 * len(runs)  # runs of broken bytes may differ in marks
    assert got[300:] == want[300:]
    assert decoder.decode(np.array([-1, 99999, 1, 2]), np.array([4])) == [""]


def test_forgetting_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(s, "REMEMBERED", 50)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    lines = texts(5, 60)
    assert encoded(s.Encoder(s.Vocabulary.parse(model)), lines) == library.encode(lines)


def test_segments_of_one_hash_are_told_apart(model, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    lines = [one, one.translate(str.maketrans("ab", "ba")), *texts(6, 40)]
    assert encoded(s.Encoder(s.Vocabulary.parse(model)), lines) == library.encode(lines)
    monkeypatch.setattr(s.Remembering, "_names", lambda self, points, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    assert encoded(s.Encoder(s.Vocabulary.parse(model)), lines) == library.encode(lines)


def test_pieces_are_compared(model, monkeypatch):
    """Also where every hash is taken for a piece's."""
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoder = s.Encoder(s.Vocabulary.parse(model))
    runs = encoder._runs
    monkeypatch.setattr(encoder, "_runs", lambda points, *sizes: [encoder.keys[np.minimum(np.searchsorted(encoder.keys, h), len(encoder.keys) - 1)] for h in runs(points, *sizes)])
    lines = texts(8, 40)
    assert encoded(encoder, lines) == library.encode(lines)


def test_long_segments_take_the_same_path(model, monkeypatch):
    lines = texts(7, 80)
    usual = encoded(s.Encoder(s.Vocabulary.parse(model)), lines)
    monkeypatch.setattr(s, "LONG", 3)
    assert encoded(s.Encoder(s.Vocabulary.parse(model)), lines) == usual


def _message(fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        elif isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram_model(extra):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    rng = random.Random(1)
    words = {"▁", *"abcde", *("".join(rng.choice("abcde▁") for _ in range(rng.randint(2, 5))) for _ in range(60))}
    pieces += [(w, -rng.random() * 9 - 1, 1) for w in sorted(words) if "▁" not in w[1:]]
    body = b"".join(_message([(1, _message([(1, p.encode()), (2, x), (3, k)]))]) for p, x, k in pieces)
    normalizer = _message([(1, b"identity"), (3, 1), (4, 0), (5, 1)])
    return body + _message([(2, _message([(3, 1), (35, 1), *extra])), (3, normalizer)])


def test_unigram_models():
    data = unigram_model([])
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcde f\n") for _ in range(rng.randint(0, 90))) for _ in range(200)] + ["abcde" * 40]
    assert encoded(s.Encoder(s.Vocabulary.parse(data)), lines) == library.encode(lines)


def test_unsupported_models():
    with pytest.raises(ValueError):
        s.Vocabulary.parse(_message([(2, _message([(3, 3)]))]))


def test_tables(spark, model):
    rows = corpus(2, 20)
    docs = clashing(spark, rows)
    found = s.decode(s.encode(docs, model), model)
    assert found.columns == [*docs.columns, "ids", "decoded"]
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = found.collect()
    assert len(got) == len(rows) and all(r.ids == library.encode(r.text or "") and r.decoded == (r.text or "") for r in got)
    trip = s.round_trip(docs, model, keep=("source",)).collect()
    assert all(r.same and r.n_tokens == len(r.ids) for r in trip) and trip[0].__fields__ == ["doc_id", "source", "n_tokens", "ids", "same"]
    assert s.encode(docs.limit(0), model).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.decoded for r in s.decode(nulls, model).collect()] == ["", ""]
