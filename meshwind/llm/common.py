"""What the corpus operators share: written intermediate tables, Arrow maps, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that a Python worker holds as objects at once.
SLICE_BYTES = 4 << 20
#: Bytes of a batch that Spark sends to a Python worker: of rows, and of a column's arguments, where each row stands for itself.
BATCH_BYTES, COLUMN_BATCH_BYTES = 8 << 20, 1 << 20
#: Edges that one task joins at most; more are first drawn together by rounds of grouped minima.
EDGES_AT_ONCE = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which all executors share.

    Only a session on one machine (tests) may go without the setting; then a temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="meshwind-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/meshwind-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, size: int):
    """Parts of a batch of about ``size`` bytes, so that a few long texts don't fill a worker."""
    if not batch.num_rows:
        return
    step = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def give_back() -> None:
    """Freed memory goes back to the system, since Python workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, make, schema: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with ``make()`` called once a task; it returns a function from RecordBatch to dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    small_batches(df.sparkSession)

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, slice_bytes):
                out = work(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)
                del out, part
            del batch
        if hasattr(work, "close"):
            work.close()
        del work
        give_back()

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Workers get batches of about ``size`` bytes, unless the session asks for less; what was set here before is not its asking."""
    name, note = "spark.sql.execution.arrow.maxBytesPerBatch", "meshwind.maxBytesPerBatch"  # note: set here last, and asked for by the session
    now, (left, asked) = spark.conf.get(name, None), spark.conf.get(note, ",").split(",")
    if now != left:
        asked = now if now is not None and now.isdigit() else ""
    size = min(size, int(asked)) if asked else size
    spark.conf.set(name, str(size))
    spark.conf.set(note, f"{size},{asked}")


def arrow_column(spark: SparkSession, make, schema: str, *columns: Column, slice_bytes: int = SLICE_BYTES) -> Column:
    """A struct column of ``schema`` from columns, by ``make()``, called once a task: it returns a function from arrays to a
    dict of columns. Spark holds the rows meanwhile, so that only these columns go to the worker."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    target = to_arrow_schema(kind)
    small_batches(spark, COLUMN_BATCH_BYTES)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        work = make()
        for arrays in batches:
            arrays = (arrays,) if isinstance(arrays, pa.Array) else arrays  # one column comes without a tuple
            batch, parts = pa.RecordBatch.from_arrays(list(arrays), [str(k) for k in range(len(arrays))]), []
            for part in slices(batch, slice_bytes):
                out = work(*part.columns)
                parts.append(pa.StructArray.from_arrays([pa.array(out[f.name], type=f.type) for f in target], fields=list(target)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(target)))
            del batch, arrays, parts
        del work
        give_back()

    return F.arrow_udf(run, kind)(*columns)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so that other columns can't clash."""
    return df.select(*[df[f"`{c}`"].alias(name) for name, c in columns.items()])


def contracted(edges: DataFrame, roots: bool) -> DataFrame:
    """(u, v) of each partition's edges, drawn together: every node with the smallest node it is linked to within the
    partition; roots: those nodes with themselves too."""

    def run(batches):
        parent: dict = {}

        def root(x):
            while (up := parent[x]) != x:
                parent[x] = parent[up]
                x = up
            return x

        def stars():
            found = [(x, root(x)) for x in parent]
            found = [(x, r) for x, r in found if roots or x != r]
            for at in range(0, len(found), 50_000):
                u, v = zip(*found[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if not roots and len(parent) > EDGES_AT_ONCE:
                yield from stars()
                parent.clear()
        yield from stars()
        parent.clear()
        give_back()

    from pyspark.sql.pandas.types import to_arrow_type

    name, kind = edges.schema["u"].dataType.simpleString(), to_arrow_type(edges.schema["u"].dataType)
    return edges.select("u", "v").mapInArrow(run, f"u {name}, v {name}")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (u, v): rows (node, comp) where comp is the component's smallest node.

    Each partition draws its own edges together. Up to EDGES_AT_ONCE that are left are joined in one task of bounded size;
    more go through rounds of large-star and small-star steps (Kiveris et al. 2014), each a grouped minimum and an equi-join
    whose result is written, until they are that few or settled.
    """
    cur = materialize(contracted(edges.where("u <> v"), False))
    seen = None
    for _ in range(max_rounds):
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now[0] <= EDGES_AT_ONCE:
            return contracted(cur.coalesce(1), True).toDF("node", "comp")
        if now == seen:
            break
        seen = now
        cur = cur.distinct()
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        cur = materialize(small.where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
