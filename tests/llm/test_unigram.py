"""Unigram segmentation against the library's own Viterbi over the same pieces and scores."""

import random

import numpy as np
import pytest

from arborist.llm import queries, unigram

sp = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def pieces():
    return unigram.zipf_scores(unigram.read_pieces(queries.tokenizer(queries.PIECES)))


@pytest.fixture(scope="module")
def library(pieces):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    with open(queries.tokenizer(queries.PIECES), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p, (_, s, _) in zip(m.pieces, pieces):
        p.score = s
    return sp.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_trie_finds_exactly_its_words():
    words = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "ß", "ßa", "zz"])}
    t = unigram.build_trie(words)
    for w in ["a", "ab", "abc", "abcd", "b", "ba", "ß", "ßa", "z", "zz", "q"]:
        s, got = 0, -1
        for c in w.encode():
            n = t.base[s] + c + 1
            if t.check[n] != s:
                got = -1
                break
            s, got = n, t.value[n]
        assert got == words.get(w.encode(), -1)


def test_ids_equal_the_library(spark, sf, pieces, library):
    model = unigram.Unigram(pieces)
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["".join(rng.choices(["a", "the", " ", "  ", "é", "中", "🙂", "\n", "x\t", "ing", "▁", "́", "Z9"], k=rng.randrange(40))) for _ in range(1500)]
    texts += ["", " ", "   ", "a", " a", "a ", "x" * 3000]
    for t, (ids, score) in zip(texts, model.encode_many(texts)):
        assert ids.tolist() == library.encode(t), repr(t)
        assert model.decode(ids.tolist()) == t.replace("▁", " ")


def test_rows(spark, pieces):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hé  llo ▁", "z"), (None, "hé", "q"), (3, "same", "r")]
    got = unigram.encode_texts(spark, spark.createDataFrame(rows, "doc_id long, text string, score string"), pieces).collect()
    assert [r.n_ids for r in got][:2] == [0, 0] and [r.lossless for r in got] == [True, True, False, True, True]
    assert unigram.encode_texts(spark, spark.createDataFrame([], "doc_id long, text string"), pieces).count() == 0
    assert np.isfinite([r.score for r in got]).all()
