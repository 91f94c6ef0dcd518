"""The feature table in a folder per month, so that time filters read only the months they need and a new
build rewrites only the months that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FeatureStore:
    def __init__(self, spark: SparkSession, path: str, time_col: str = "as_of_date"):
        self.spark, self.path, self.time_col = spark, path.rstrip("/"), time_col

    def write(self, features: DataFrame) -> None:
        """Replace the months that occur in ``features``; other months stay as they are."""
        month = F.date_format(self.time_col, "yyyy-MM")
        (features.withColumn("month", month).repartition("month", F.pmod(F.xxhash64(*features.columns), F.lit(8)))
         .write.partitionBy("month").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path))

    def read(self, since=None, until=None) -> DataFrame:
        """Rows with ``since <= time < until`` (either may be left out); the month filter prunes folders."""
        df = self.spark.read.option("basePath", self.path).schema(self._schema()).parquet(self.path)
        t = F.col(self.time_col)
        for bound, rows, month in ((since, t >= F.lit(since), lambda m: F.col("month") >= m),
                                   (until, t < F.lit(until), lambda m: F.col("month") <= m)):
            if bound is not None:
                df = df.filter(rows & month(f"{bound:%Y-%m}"))
        return df

    def _schema(self) -> T.StructType:
        """The stored columns; month is text whatever the folder names look like."""
        found = self.spark.read.parquet(self.path).schema
        return T.StructType([f if f.name != "month" else T.StructField("month", T.StringType()) for f in found])

    def changed_months(self, features: DataFrame) -> list[str]:
        """Months whose rows differ from the stored ones (count or sum of row hashes), in order."""
        old = self.read().drop("month")
        cols = old.columns

        def digest(df):
            return df.groupBy(F.date_format(self.time_col, "yyyy-MM").alias("month")).agg(
                F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h"))

        a, b = digest(features.select(*cols)), digest(old).select("month", F.col("n").alias("n0"), F.col("h").alias("h0"))
        gone = ~(F.col("n").eqNullSafe(F.col("n0")) & F.col("h").eqNullSafe(F.col("h0")))
        return sorted(r["month"] for r in a.join(b, "month", "left").filter(gone).select("month").collect())  # months
