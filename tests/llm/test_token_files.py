import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwind.llm import token_files as T
from meshwind.llm.common import shared_dir
from meshwind.llm.elias_fano import EliasFano, encode

MARK = "<|endoftext|>"


def _model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.TOKENIZER_PATH)


def _brute(rows):
    model, at, out = _model(), 0, []
    for i, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    return out


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0, 5], list(range(0, 5000, 3)), [0, 1, 2**40], [3] * 2000 + [10**9] * 3, [2**62 + 5]])
def test_elias_fano_selects_every_number(values):
    read = EliasFano(encode(np.array(values, np.int64)))
    assert len(read) == len(values)
    assert read.select(np.arange(len(values))).tolist() == values


def test_elias_fano_is_small_and_random():
    rng = np.random.default_rng(5)
    values = np.cumsum(rng.geometric(1 / 400, 100_000))
    data = encode(values)
    assert len(data) * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 0.5
    places = rng.integers(0, len(values), 1000)
    assert (EliasFano(data).select(places) == values[places]).all()


def test_words_between_spaces_equal_the_whole():
    texts = ["", None, " ", "a", "The cat's  toy\n\tran.\r\n", f"x{MARK}y {MARK} <|startoftext|>", "Á ẹ́ ́mark ÀÉ", "İstanbul ΣΑΣ ς", " wide　 space here\x1cand\x85there", "你好 世界123 45", "🙂🙂 don't I'LL", "q" * 5000, "a b " * 500]
    model = _model()
    encoder = T.WordEncoder(open(T.TOKENIZER_PATH, encoding="utf-8").read())
    for _ in range(2):  # the second time from kept words
        ids, sizes = encoder.encode(pa.array(texts, pa.string()), 1)
        want = [[*model.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]
    sliced = pa.array(["zz", *texts], pa.string()).slice(1)
    assert encoder.encode(sliced, 1)[0].tolist() == ids.tolist()


def test_random_texts_equal_the_whole():
    rng = np.random.default_rng(11)
    alphabet = list("abcXYZ019'.,-<|> \n\t") + ["é", "ß", "İ", "\u0301", "\u00ad", "\u0338", "世", "'s", "'re", "\x1c", "\u00a0", "\u2028", MARK[:5], MARK]
    texts = ["".join(alphabet[k] for k in rng.integers(0, len(alphabet), rng.integers(0, 40))) for _ in range(3000)]
    model, encoder = _model(), T.WordEncoder(open(T.TOKENIZER_PATH, encoding="utf-8").read())
    ids, sizes = encoder.encode(pa.array(texts), 1)
    want = [[*x.ids, 1] for x in model.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]
    other = json.loads(open(T.TOKENIZER_PATH, encoding="utf-8").read())
    other["normalizer"] = None
    text = json.dumps(other)
    assert T.WordEncoder(text).encode(pa.array(["Two Words"]), 1)[0].tolist() == [*type(model).from_str(text).encode("Two Words").ids, 1]


def test_round_trip_equals_brute_force(spark, monkeypatch):
    rows = [(i * 7 % 101 - 30, t) for i, t in enumerate(["some words here", "", None, "other words", "long " * 3000] * 20)]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, id string, place string, start int").repartition(7)
    monkeypatch.setattr(T, "FILE_BYTES", 20_000)
    monkeypatch.setattr(T, "READ_BYTES", 9_000)
    got = sorted(map(tuple, T.token_report(docs).collect()))
    assert got == sorted(_brute(sorted(rows, key=lambda r: r[0])))


def test_nulls_ties_empty_tables_and_ids(spark):
    rows = [(None, "a b"), (None, None), (5, "x"), (5, "x"), (-(2**63), "low"), (2**63 - 1, "high")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = shared_dir(spark)
    manifest = T.write_tokens(docs, folder)
    got = sorted(T.read_tokens(manifest, folder, ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -(2**63), 5, 5, 2**63 - 1]
    model = _model()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted((i or 0, [*model.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert T.token_report(docs.where("doc_id = 77")).count() == 0
    with pytest.raises(TypeError):
        T.write_tokens(docs.select(F.col("text").alias("doc_id"), "text"), folder)


def test_a_cut_file_is_an_error(tmp_path):
    (tmp_path / "x.tok").write_bytes(b"\0" * 100)
    with pa.OSFile(str(tmp_path / "x.tok")) as f, pytest.raises(ValueError):
        list(T.read_file(f))
