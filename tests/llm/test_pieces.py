import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from meshwind.llm import common, pieces

sentencepiece = pytest.importorskip("sentencepiece")
POOL = ["  ", "   ", " ", "\n", "\t", "é", "ß", "the", "ing", "日本", "😀", "　", "▁", "\x00", "def", "_", "foo(", "0", "1234", ".", "http://", "=", "    return", "€", "ation", "un", "A", " " * 17]


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL_PATH, "rb") as f:
        proto = f.read()
    return pieces.Encoder(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)


def test_ids_equal_the_library(model):
    own, library = model
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["", " ", " " * 300, "x" * 3000, "\n" * 500]
    assert own.encode(texts) == library.encode(texts, num_threads=1)


def test_edges_are_all_occurrences(model):
    text = "▁the▁cat" + pieces.BETWEEN + "thethe" + pieces.BETWEEN
    a, b, t = model[0].edges(np.array([ord(c) for c in text], np.int32))
    want = {(i, j, model[0].v.ids[text[i:j]]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in model[0].v.ids and "▁" not in text[i + 1 : j] and model[0].v.merge(text[i:j]) == [text[i:j]]}
    assert set(zip(a.tolist(), b.tolist(), t.tolist())) == want


def test_wide_alphabet_needs_several_numbers_a_suffix(model):
    rnd = random.Random(2)
    text = "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(20_000)) + " international" * 3
    assert model[0].encode([text]) == [model[1].encode(text)]


def test_pairs_stay_apart_as_in_the_merge_itself(model):
    own, rnd = model[0], np.random.RandomState(3)
    left, right = (rnd.choice(own.name_ids[own.whole[own.name_ids]], 3000) for _ in range(2))
    want = [own.v.merge(own.text[a] + own.text[b]) == [own.text[a], own.text[b]] for a, b in zip(left, right)]
    assert own._stays(left, right).tolist() == want
    assert own._apart(left, right).tolist() == want and own._apart(left, right).tolist() == want


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ACGT", "abcdefXYZ0123456789+/", "日本語中国", "z"])
def test_long_text_without_spaces(model, alphabet):
    rnd = random.Random(4)
    text = "".join(rnd.choice(alphabet) for _ in range(100_000))
    assert model[0].encode([text, "a", text[:70]]) == model[1].encode([text, "a", text[:70]], num_threads=1)


def test_encoding_takes_little_memory_beside_the_texts(model):
    rnd = random.Random(5)
    words = [x + y + z for x in ("inter", "under", "over", "counter") for y in ("nation", "stand", "order", "model") for z in ("al", "ing", "ed", "s", "")]
    texts = [" ".join(rnd.choices(words, k=2000)) for _ in range(150)]
    size = sum(map(len, texts))
    model[0].encode_flat(texts[:2])
    tracemalloc.start()
    try:
        flat, at = model[0].encode_flat(texts)
        model[0].spelled_out(flat, at)
        assert tracemalloc.get_traced_memory()[1] < 26 * size
    finally:
        tracemalloc.stop()


def test_a_batch_is_encoded_in_slices_of_little_memory(model):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices(["international", "understanding", "models", "the", "of", "0123", "x=y"], k=800)) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    model[0].encode_flat(texts[:2])
    tracemalloc.start()
    try:
        count = sum(len(model[0].encode_flat(part.column(0).to_pylist())[0]) for part in common.slices(batch, pieces.AT_ONCE))
        assert tracemalloc.get_traced_memory()[1] < 30 << 20
    finally:
        tracemalloc.stop()
    assert count == sum(map(len, model[1].encode(texts, num_threads=1)))


def test_query_on_odd_rows(spark, model):
    texts = [None, "", "a  b", "▁", "word " * 20_000, "z" * 20_000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(2, "a  b", "k"), (None, "x", "k")], "doc_id long, text string, ids string")
    got = pieces.encode_documents(docs)
    rows = {r.id: r for r in got.collect()}
    assert got.count() == len(texts) + 2
    for i, t in enumerate(texts):
        ids = model[1].encode(t or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids) and rows[i].round_trip == (t != "▁")
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
    back = {r.id: r.text for r in pieces.decode_documents(got).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if t != "▁")
    assert pieces.encode_documents(docs.limit(0)).count() == 0
