"""Downloads as a Spark data source: one partition a symbol, read where tasks run.

    spark.dataSource.register(MarketSource)
    spark.read.format("market").option("provider", "yfinance").option("symbols", "SPY,TLT").option("start", "2015-01-01").load()
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PROVIDERS = ("yfinance", "fred")


class Symbol(InputPartition):
    def __init__(self, name: str):
        self.name = name


class MarketReader(DataSourceReader):
    """Rows (date, asset, value) of each symbol; a symbol without data is an error, a missing library an ImportError that names it."""

    def __init__(self, options: dict[str, str]):
        self.provider = options.get("provider", "yfinance")
        self.symbols = [s.strip() for s in options.get("symbols", "").split(",") if s.strip()]
        self.start, self.end = options.get("start"), options.get("end")
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider!r}: {', '.join(PROVIDERS)}")
        if not self.symbols:
            raise ValueError("name one symbol or more")

    def partitions(self):
        return [Symbol(s) for s in self.symbols]

    def read(self, partition: Symbol):
        frame = self._prices(partition.name) if self.provider == "yfinance" else self._series(partition.name)
        if frame is None or not len(frame):
            raise RuntimeError(f"no data came back for {partition.name}")
        for when, value in frame.items():
            if value == value:
                yield dt.date(when.year, when.month, when.day), partition.name, float(value)

    def _prices(self, name: str):
        try:
            import yfinance
        except ImportError as e:
            raise ImportError("yfinance is required for this download; install it, or load a CSV file instead") from e
        got = yfinance.download([name], start=self.start, end=self.end, auto_adjust=False, progress=False, threads=False)
        if got is None or not len(got):
            return None
        for want in ("Adj Close", "Close"):
            for c in got.columns:
                if c == want or isinstance(c, tuple) and {want, name} <= set(c):
                    return got[c]
        raise RuntimeError(f"the download of {name} has no close prices")

    def _series(self, name: str):
        try:
            from pandas_datareader.data import DataReader
        except ImportError as e:
            raise ImportError("pandas_datareader is required for this download; install it, or load a CSV file instead") from e
        return DataReader(name, "fred", self.start, self.end)[name]


class MarketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "market"

    def schema(self) -> str:
        return "date date, asset string, value double"

    def reader(self, schema) -> MarketReader:
        return MarketReader(self.options)
