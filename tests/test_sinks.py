import os

import pytest
from pyspark.sql import functions as F

from meshwind.sources import panels


def _rows(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_tables_of_a_run_appear_together(spark, tmp_path, fmt):
    folder = f"{tmp_path}/out"
    panels.write_tables({"a": spark.range(3), "b": spark.range(4)}, folder, fmt)
    assert sorted(os.listdir(folder)) == ["a", "b"]
    broken = spark.range(2).select(F.when(F.col("id") >= 0, F.raise_error(F.lit("stop"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        panels.write_tables({"a": spark.range(9), "b": broken, "c": spark.range(1)}, folder, fmt)
    assert sorted(os.listdir(folder)) == ["a", "b"]
    if fmt == "parquet":
        assert _rows(spark, f"{folder}/a") == [0, 1, 2] and _rows(spark, f"{folder}/b") == [0, 1, 2, 3]
        panels.write_tables({"a": spark.read.parquet(f"{folder}/a").where("id > 0"), "c": spark.range(1)}, folder)  # reads what it replaces
        assert _rows(spark, f"{folder}/a") == [1, 2] and sorted(os.listdir(folder)) == ["a", "b", "c"]


def test_a_failed_rename_is_undone(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/out"
    panels.write_tables({"a": spark.range(3), "b": spark.range(4)}, folder)
    real = panels._store

    def store(session, where):
        path, fs = real(session, where)

        class Failing:
            def __getattr__(self, name):
                return getattr(fs, name)

            def rename(self, x, y):
                return False if y.getName() == "b" and "_staged" in x.toString() and "_old" not in x.toString() else fs.rename(x, y)

        return path, Failing()

    monkeypatch.setattr(panels, "_store", store)
    with pytest.raises(OSError, match="in place"):
        panels.write_tables({"a": spark.range(7), "b": spark.range(8)}, folder)
    assert _rows(spark, f"{folder}/a") == [0, 1, 2] and _rows(spark, f"{folder}/b") == [0, 1, 2, 3] and sorted(os.listdir(folder)) == ["a", "b"]


def test_scratch_tables_go_when_left(spark):
    with panels.scratch(spark):
        df = panels.stored(spark.range(5))
        folder = panels._FOLDERS[-1].removeprefix("file://").removeprefix("file:")
        assert df.count() == 5 and os.path.isdir(folder)
    assert not os.path.isdir(folder)
