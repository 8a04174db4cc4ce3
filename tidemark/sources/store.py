"""Bars at rest: Parquet by bar length and symbol."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.bars import clean


class BarStore:
    """A folder with one partition per bar length and symbol; a write replaces the symbols it holds."""

    def __init__(self, spark: SparkSession, root: str, length: str) -> None:
        self.spark, self.root, self.length = spark, root.rstrip("/"), length

    def _all(self) -> DataFrame | None:
        try:
            path = f"{self.root}/candle={self.length}"
            held = self.spark.read.option("basePath", path).parquet(path)
            # A named type for the partition, or symbols of digits would be read as numbers.
            kinds = [f for f in held.schema.fields if f.name != "symbol"]
            typed = T.StructType([*kinds, T.StructField("symbol", T.StringType())])
            return self.spark.read.schema(typed).option("basePath", path).parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def write(self, bars: DataFrame) -> None:
        rows = bars.drop("candle").withColumn("candle", F.lit(self.length))
        (
            rows.repartition("candle", "symbol")
            .sortWithinPartitions("symbol", "ts")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("candle", "symbol")
            .parquet(self.root)
        )

    def read(self, symbols: list[str] | None = None) -> DataFrame:
        """Bars of the symbols (all if none are named); only their partitions are read."""
        found = self._all()
        if found is None:
            raise FileNotFoundError(f"no bars under {self.root}/candle={self.length}")
        found = found.where(F.col("symbol").isin(symbols)) if symbols is not None else found
        return clean(found)

    def tickers(self) -> list[str]:
        found = self._all()
        return [] if found is None else sorted(r[0] for r in found.select("symbol").distinct().collect())

    def exists(self, symbol: str) -> bool:
        found = self._all()
        return found is not None and bool(found.where(F.col("symbol") == symbol).take(1))

    def missing(self, universe: DataFrame) -> DataFrame:
        """Rows of universe(symbol, ...) that have no bars here."""
        found = self._all()
        return universe if found is None else universe.join(found.select("symbol").distinct(), "symbol", "left_anti")
