"""Sources and sinks: market CSV files, cached tables, download connectors, panels from the star schema."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import num

#: Fixed names of a first column that is an index.
INDEX_NAMES = ("", "date", "datetime", "timestamp", "time", "index", "unnamed: 0", "_c0")


def _date(c: str):
    text = F.trim(F.col(f"`{c}`"))
    return F.coalesce(text.try_cast("date"), F.try_to_timestamp(text).cast("date"))


def looks_like_dates(df: DataFrame, column: str) -> bool:
    """At least nine tenths of the values are dates, and they are not numbers."""
    c = F.col(f"`{column}`")
    row = df.agg(F.avg(_date(column).isNotNull().cast("double")).alias("d"), F.avg(c.try_cast("double").isNotNull().cast("double")).alias("n")).first()
    return bool(row["d"] is not None and row["d"] >= 0.9 and (row["n"] or 0) < 0.9)


def load_market_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide panel: date (if the first column is an index of dates; else the first column's text as ``row``), one double column an asset.

    Values that are no finite numbers are null; columns without any value are dropped; dates sort the rows.
    """
    try:
        raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if not raw.columns or raw.isEmpty():
        raise ValueError(f"CSV file is empty: {path}")
    first, index = raw.columns[0], None
    if len(raw.columns) > 1 and (first.strip().lower() in INDEX_NAMES or looks_like_dates(raw, first)):
        whole = raw.agg(F.min(_date(first).isNotNull())).first()[0]
        index = _date(first).alias("date") if whole else F.col(f"`{first}`").alias("row") if first.strip().lower() in ("index", "unnamed: 0", "_c0", "") else None
    assets = raw.columns[1:] if index is not None else raw.columns
    wide = raw.select(*([index] if index is not None else []), *[num(F.col(f"`{a}`")).alias(a) for a in assets])
    counts = wide.agg(*[F.count(F.col(f"`{a}`")).alias(a) for a in assets]).first()
    out = wide.drop(*[a for a in assets if not counts[a]])
    return out.orderBy("date") if "date" in out.columns else out


def load_prices_csv(spark: SparkSession, path: str) -> DataFrame:
    return load_market_csv(spark, path)


def load_returns_csv(spark: SparkSession, path: str) -> DataFrame:
    return load_market_csv(spark, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A cached table: a folder of Parquet, or a CSV file whose first column is the date."""
    return load_market_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def _store(spark: SparkSession, folder: str):
    """Hadoop's path class and the file system of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One table a file name; fmt parquet or csv. All tables are written aside first and put in place when the last is there, so that
    one that fails leaves the folder as it was; tables may read what they replace. Where a rename fails midway, those before it are undone."""
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    path, store = _store(spark, folder)
    aside = f"{folder}/_staged-{uuid.uuid4().hex}"
    done: list[tuple[str, bool]] = []

    def move(a: str, b: str) -> None:
        if not store.rename(path(a), path(b)):
            raise OSError(f"could not put {b} in place")

    try:
        for name, df in tables.items():
            out = f"{aside}/{name}"
            df.write.parquet(out) if fmt == "parquet" else df.write.option("header", True).csv(out)
        for name in tables:
            had = bool(store.exists(path(f"{folder}/{name}")))
            if had:
                move(f"{folder}/{name}", f"{aside}/_old-{name}")
            done.append((name, had))
            move(f"{aside}/{name}", f"{folder}/{name}")
    except BaseException:
        for name, had in reversed(done):
            if had:
                store.delete(path(f"{folder}/{name}"), True)
                store.rename(path(f"{aside}/_old-{name}"), path(f"{folder}/{name}"))
            else:
                store.delete(path(f"{folder}/{name}"), True)
        raise
    finally:
        store.delete(path(aside), True)


#: Folders of intermediate tables that this process has named and not yet given back.
_FOLDERS: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes on leaving all intermediate tables that were written within; results have to be read or written by then."""
    before = len(_FOLDERS)
    try:
        yield
    finally:
        for folder in _FOLDERS[before:]:
            path, store = _store(spark, folder)
            store.delete(path(folder), True)
        del _FOLDERS[before:]


def new_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, set on the session or its context, which all executors share. Only a
    session on one machine (tests) may go without; then a temporary folder is used."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = own.get() if own.isDefined() else None
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="meshwind-")
    _FOLDERS.append(f"{root.rstrip('/')}/meshwind-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def stored(df: DataFrame) -> DataFrame:
    """df written to a new shared folder and read back: later plans start from a short scan, and lost executors lose nothing."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def to_long(wide: DataFrame, assets: Sequence[str] | None = None) -> DataFrame:
    """(date, asset, value) of a wide panel, nulls kept."""
    assets = list(assets or [c for c in wide.columns if c != "date"])
    return wide.select("date", F.explode(F.array(*[F.struct(F.lit(a).alias("asset"), num(F.col(f"`{a}`")).alias("value")) for a in assets])).alias("x")).select("date", "x.asset", "x.value")


def to_wide(panel: DataFrame, assets: Sequence[str]) -> DataFrame:
    return panel.groupBy("date").pivot("asset", list(assets)).agg(F.first("value"))


def _download(module: str, fetch):
    try:
        library = __import__(module)
    except ImportError as e:
        raise ImportError(f"{module} is required for this download; install it, or load a CSV file instead") from e
    try:
        return fetch(library)
    except Exception as e:
        raise RuntimeError(f"the download failed: {e}") from e


def price_columns(columns: Sequence[str | tuple], tickers: Sequence[str]) -> dict[str, object]:
    """Of downloaded column labels, flat or (field, ticker) in either order, the adjusted close of each ticker, else its close."""
    out = {}
    for t in tickers:
        for want in ("Adj Close", "Close"):
            hit = next((c for c in columns if (isinstance(c, tuple) and {want, t} <= set(c)) or (c == want and len(tickers) == 1)), None)
            if hit is not None:
                out[t] = hit
                break
    if not out:
        raise RuntimeError("the download has no close prices")
    return out


def download_prices(spark: SparkSession, tickers: Sequence[str], start: str, end: str | None = None) -> DataFrame:
    """Wide close prices from the optional yfinance library."""
    if not tickers:
        raise ValueError("tickers must contain at least one symbol")

    def fetch(library):
        got = library.download(list(tickers), start=start, end=end, auto_adjust=False, progress=False, threads=False)
        if got is None or got.empty:
            raise RuntimeError("no data came back")
        chosen = price_columns(list(got.columns), tickers)
        frame = got[list(chosen.values())].set_axis(list(chosen), axis=1)
        return spark.createDataFrame(frame.rename_axis("date").reset_index()).withColumn("date", F.to_date("date"))

    return _download("yfinance", fetch)


def download_vix(spark: SparkSession, start: str, end: str | None = None) -> DataFrame:
    return download_prices(spark, ["^VIX"], start, end).withColumnRenamed("^VIX", "vix").where("vix is not null")


def load_recession_indicator(spark: SparkSession, series_id: str = "USREC", start: str | None = None, end: str | None = None) -> DataFrame:
    """(date, <series id in lower case>) from the optional pandas_datareader library."""

    def fetch(library):
        got = __import__("pandas_datareader.data", fromlist=["DataReader"]).DataReader(series_id, "fred", start, end)
        return spark.createDataFrame(got.set_axis([series_id.lower()], axis=1).rename_axis("date").reset_index()).withColumn("date", F.to_date("date"))

    return _download("pandas_datareader", fetch)


def star_panel(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Price-like panels of the star schema: W3 (week, return flag), W2, W4 and D4 (week or day, supplier group), W5 (week, priority), H5 (hour, event type)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if which in ("W2", "W3", "W4", "D4"):
        unit, asset = ("day" if which == "D4" else "week"), F.col("l_returnflag") if which == "W3" else F.concat(F.lit("s"), F.pmod("l_suppkey", F.lit(2 if which == "W2" else 4)).cast("string"))
        df = read("lineitem").select(F.date_trunc(unit, "l_shipdate").cast("date").alias("date"), asset.alias("asset"), F.col("l_extendedprice").alias("v"))
    elif which == "W5":
        df = read("orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("asset"), F.col("o_totalprice").alias("v"))
    else:
        df = read("events").select(F.date_trunc("hour", "ts").alias("date"), F.col("event_type").alias("asset"), F.col("value").alias("v"))
    return df.groupBy("date", "asset").agg(F.avg("v").alias("value"))
