
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from meshwind.llm import pieces

SF = "/root/testdata/sf0.001"
INSULTS = "you grobblin and you snarfwit and zugnut zugnut grobblin"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    words = [f"word{k}" for k in range(400)]
    text = lambda i, n=60: " ".join(words[(i * 37 + k * k * (i + 3)) % 400] for k in range(n))
    rows = [(i, text(i) + (" " + INSULTS if i % 5 == 0 else "") + ".") for i in range(300)]
    passage = "the quick brown fox jumps over one very lazy sleeping dog today"
    rows += [(400, text(401)), (401, text(401)), (402, text(401) + " x"), (403, text(403) + " " + passage.upper()), (404, text(404) + " token=0123456789abcdef0123456789abcdef"), (405, None), (406, ""), (407, text(407)), (407, text(407))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows)


def grams(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, folder))
        seen.append({r[0] for r in docs.select("doc_id").collect()})
        assert name == P.STAGES[-1][0] or docs.columns == columns
    assert seen[0] == {i for i in texts if not (i < 300 and i % 5 == 0)}
    keep = {i: grams(t or "") for i, t in texts.items() if i in seen[0]}
    root = {i: min([j for j, b in keep.items() if a and b and 100 * len(a & b) >= 80 * len(a | b)] or [i]) for i, a in keep.items()}
    assert seen[1] == {i for i in keep if root[i] == i}
    assert seen[2] == seen[1] - {403} and seen[3] == seen[2] and seen[4] == seen[3]
    rows = {r.doc_id: r for r in docs.collect()}
    assert docs.count() == len(rows)
    with open(pieces.MODEL_PATH, "rb") as f:
        own = pieces.Encoder(f.read())
    for i, r in rows.items():
        want = (texts[i] or "").replace("token=0123456789abcdef0123456789abcdef", "[SECRET]")
        assert r.ids == own.encode([want])[0] and r.n_chars == len(want) and r.round_trip


def test_run_over_a_test_table(spark):
    out = P.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.count() < docs.count() and out.where(~F.col("round_trip")).count() == 0


def test_near_duplicates_are_dropped_by_row(spark):
    """Null and repeated ids: one row of each component stays, and rows that only share an id with a copy stay."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (None, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (5, text(1)), (5, text(5)), (6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3], rows[6], (6, ""), (6, "")], key=str)


@pytest.mark.parametrize("rows", [0, 40])
def test_stages_keep_columns_of_any_name(spark, tmp_path, rows):
    """Columns named like internal ones, a very long text, empty tables of documents, labels and items."""
    made = [(i, "x" * 3, f"plain words number {i} " + "and so on " * (20_000 if i == 7 else 3), 1, i, "m", "r", "d", 2, 3) for i in range(rows)]
    schema = "doc_id long, lang string, text string, ids int, N_TOKENS int, _metadata string, _row string, doc string, id int, n_chars long"
    spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    last = P.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.columns == ["doc_id", "lang", "_metadata", "_row", "doc", "id", "n_chars", "n_tokens", "ids", "ids_sha256", "round_trip"]
    assert last.count() == docs.count() and (rows == 0 or last.first()["_metadata"] == "m")
