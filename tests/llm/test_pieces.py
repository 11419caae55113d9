"""The piece encoder against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from annalist.llm import pieces, queries

PATH = queries.vocabulary(queries.PIECES_FILE)
SYMBOLS = ["a", "e", "t", "h", " ", "  ", "▁", "\n", "\t", "1", "é", "日", "本", "😀", "́", "\0", "<s>", "<0x0A>", "the", "ing", "──", "ж", "-", "=", "\r\n", "İ", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(library, text: str) -> None:
    ids = np.frombuffer(pieces.model(PATH).encode(text), "<i4")
    assert ids.tolist() == library.encode(text), text[:200]
    assert pieces.model(PATH).decode(ids) == library.decode(ids.tolist())


def test_random_texts(library):
    rng, own = random.Random(1), list(pieces.model(PATH).id_of)
    for _ in range(3000):
        same(library, "".join(rng.choice(SYMBOLS if rng.random() < 0.5 else own) for _ in range(rng.randrange(30))))
        same(library, " " * rng.randrange(60) + "the" + " " * rng.randrange(40) + "cat" + " " * rng.randrange(20))
        same(library, "".join(rng.choice("etainos") for _ in range(rng.randrange(120))))


@pytest.mark.parametrize("text", ["", " ", "▁", "a" * 50_000, "日本語" * 9_000, "=-" * 20_000, " " * 10_001, "the" * 30_000, "\n" * 5_000, "ab" * 3 + "é" * 7_000])
def test_long_texts_without_words(library, text):
    same(library, text)


def test_decoding_any_ids(library):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(259, 32_000) for _ in range(rng.randrange(12))]
        assert pieces.model(PATH).decode(np.array(ids, "i4")) == library.decode(ids), ids


def test_cutting_and_caching_change_nothing(library, monkeypatch):
    m = pieces.Model(PATH)
    rng = random.Random(3)
    texts = ["".join(rng.choice(SYMBOLS) for _ in range(40)) for _ in range(200)]
    want = [m.encode(t) for t in texts]
    m.segments = lambda text: [text]
    assert [m.encode(t) for t in texts] == want
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(pieces, "PAIR_ENTRIES", 3)
    small = pieces.Model(PATH)
    assert [small.encode(t) for t in texts] == want and len(small.cache) <= 3 and len(small.goes) <= 3


def test_pieces_that_no_merge_reaches_are_left_out(tmp_path):
    """`abc` can't be merged, as neither `ab` nor `bc` is a piece; a longest match alone would take it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    kept = [p for p in proto.pieces if p.type != 1] + [p for p in proto.pieces if p.type == 1 and len(p.piece) == 1]
    del proto.pieces[:]
    proto.pieces.extend(kept)
    for piece, score in (("abc", -1.0), ("de", -2.0), ("def", -3.0), ("fg", -1.5), ("efg", -1.2), ("▁d", -0.5)):
        proto.pieces.add(piece=piece, score=score)
    path = tmp_path / "own.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    m, rng = pieces.Model(str(path)), random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice("abcdefg d") for _ in range(rng.randrange(20)))
        assert np.frombuffer(m.encode(text), "<i4").tolist() == library.encode(text), text


def test_frames(spark, library):
    rows = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "x  y\n"), (4, "日本 " * 20_000)]
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, id string, ids string, n_tokens string").repartition(3)
    got = sorted((tuple(r) for r in pieces.digests(pieces.decode(pieces.encode(frame, PATH), PATH)).collect()), key=str)
    want = []
    for k, text in rows:
        ids = library.encode(text or "")
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pieces.digests(pieces.decode(pieces.encode(frame.limit(0), PATH), PATH)).collect() == []
