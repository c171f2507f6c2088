import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwind.llm import common

NAME, NOTE = "spark.sql.execution.arrow.maxBytesPerBatch", "meshwind.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(NAME, None)
    for name in (NAME, NOTE):
        spark.conf.unset(name)
    yield
    spark.conf.unset(NOTE)
    spark.conf.unset(NAME) if before is None else spark.conf.set(NAME, before)


def test_columns_go_to_workers_in_small_batches(spark, unset):
    docs = spark.range(0, 6000, numPartitions=1).select("id", F.repeat(F.lit("x"), 1000).alias("text"))

    def make():
        return lambda texts: {"n": pa.array([texts.nbytes] * len(texts)), "same": pa.array([t == "x" * 1000 for t in texts.to_pylist()])}

    got = docs.select("id", common.arrow_column(spark, make, "struct<n:long,same:boolean>", F.col("text"), slice_bytes=64 << 20).alias("t"))
    row = got.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.max("t.n").alias("most"), F.min("t.same").alias("same")).first()
    assert (row.rows, row.ids, row.same) == (6000, 6000, True) and row.most < 1.5 * (1 << 20)


def test_batches_of_a_column_are_not_left_to_other_operators(spark, unset):
    sizes = []
    for size in (common.COLUMN_BATCH_BYTES, common.BATCH_BYTES, common.COLUMN_BATCH_BYTES):
        common.small_batches(spark, size)
        sizes.append(int(spark.conf.get(NAME)))
    assert sizes == [1 << 20, 8 << 20, 1 << 20]
    spark.conf.set(NAME, "2000000")  # the session's own, kept where it is less
    for size, want in ((common.BATCH_BYTES, 2000000), (common.COLUMN_BATCH_BYTES, 1 << 20), (common.BATCH_BYTES, 2000000)):
        common.small_batches(spark, size)
        assert int(spark.conf.get(NAME)) == want
