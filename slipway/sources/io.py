"""Sources, sinks and the typed catalog.

Tables live as parquet folders under a root (a shared filesystem on a
cluster); writes are task-parallel Spark writes, never driver loops over
rows. CSV sources are read with an explicit schema (no inference, so a
byte-order mark in the header is harmless).
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typed catalog of the eight marketplace tables.
CATALOG: dict[str, T.StructType] = {
    "sellers": T.StructType([T.StructField("seller_id", T.StringType(), False),
                             T.StructField("seller_zip_code_prefix", T.IntegerType()),
                             T.StructField("seller_city", T.StringType()),
                             T.StructField("seller_state", T.StringType())]),
    "customers": T.StructType([T.StructField("customer_id", T.StringType(), False),
                               T.StructField("customer_unique_id", T.StringType()),
                               T.StructField("customer_zip_code_prefix", T.IntegerType()),
                               T.StructField("customer_city", T.StringType()),
                               T.StructField("customer_state", T.StringType())]),
    "products": T.StructType([T.StructField("product_id", T.StringType(), False),
                              T.StructField("product_category_name", T.StringType()),
                              T.StructField("product_category_english", T.StringType()),
                              T.StructField("product_weight_g", T.DoubleType()),
                              T.StructField("product_length_cm", T.DoubleType()),
                              T.StructField("product_height_cm", T.DoubleType()),
                              T.StructField("product_width_cm", T.DoubleType())]),
    "orders": T.StructType([T.StructField("order_id", T.StringType(), False),
                            T.StructField("customer_id", T.StringType()),
                            T.StructField("order_status", T.StringType()),
                            T.StructField("order_purchase_timestamp", T.TimestampType()),
                            T.StructField("order_approved_at", T.TimestampType()),
                            T.StructField("order_delivered_carrier_date", T.TimestampType()),
                            T.StructField("order_delivered_customer_date", T.TimestampType()),
                            T.StructField("order_estimated_delivery_date", T.TimestampType()),
                            T.StructField("is_late", T.IntegerType()),
                            T.StructField("delay_days", T.DoubleType())]),
    "order_items": T.StructType([T.StructField("order_id", T.StringType(), False),
                                 T.StructField("order_item_id", T.IntegerType(), False),
                                 T.StructField("product_id", T.StringType()),
                                 T.StructField("seller_id", T.StringType()),
                                 T.StructField("shipping_limit_date", T.TimestampType()),
                                 T.StructField("price", T.DoubleType()),
                                 T.StructField("freight_value", T.DoubleType())]),
    "reviews": T.StructType([T.StructField("review_id", T.StringType(), False),
                             T.StructField("order_id", T.StringType(), False),
                             T.StructField("review_score", T.IntegerType()),
                             T.StructField("review_comment_message", T.StringType()),
                             T.StructField("review_creation_date", T.TimestampType())]),
    "external_signals": T.StructType([T.StructField("signal_id", T.LongType(), False),
                                      T.StructField("seller_state", T.StringType()),
                                      T.StructField("signal_date", T.DateType()),
                                      T.StructField("source", T.StringType()),
                                      T.StructField("value", T.DoubleType()),
                                      T.StructField("is_synthetic", T.IntegerType())]),
    "predictions": T.StructType([T.StructField("prediction_id", T.LongType(), False),
                                 T.StructField("seller_id", T.StringType()),
                                 T.StructField("risk_score", T.DoubleType()),
                                 T.StructField("risk_band", T.StringType()),
                                 T.StructField("model_name", T.StringType()),
                                 T.StructField("top_features", T.ArrayType(T.StructType([
                                     T.StructField("feature", T.StringType()),
                                     T.StructField("contribution", T.DoubleType())]))),
                                 T.StructField("predicted_at", T.TimestampType())]),
}
OPTIONAL_SOURCES = {"external_signals"}


def _hadoop(spark: SparkSession | None, path: str):
    """The file system that Spark itself uses for ``path`` (local, hdfs, object
    stores), and the path in its terms."""
    spark = spark or SparkSession.builder.getOrCreate()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(path: str, spark: SparkSession | None = None) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


class TableStore:
    """Parquet tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # S16
    def create_all(self) -> list[str]:
        for name, schema in CATALOG.items():
            if not self.exists(name):
                self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self.path(name))
        return list(CATALOG)

    def drop_all(self) -> None:
        """Remove the catalog's tables; ``truncate`` empties one and keeps it."""
        for name in CATALOG:
            fs, p = _hadoop(self.spark, self.path(name))
            fs.delete(p, True)

    def exists(self, table: str) -> bool:
        return path_exists(self.path(table), self.spark)

    # S07 / S08
    def read_table(self, table: str, limit: int | None = None) -> DataFrame:
        """Whole table; ``limit`` 0/None means no limit (the sampling feature)."""
        df = self.spark.read.schema(CATALOG[table]).parquet(self.path(table)) if table in CATALOG \
            else self.spark.read.parquet(self.path(table))
        return df.limit(limit) if limit else df

    def read_query(self, sql: str, tables: list[str]) -> DataFrame:
        for t in tables:
            self.read_table(t).createOrReplaceTempView(t)
        return self.spark.sql(sql)

    # S09 / S10 / S11
    def write_df(self, df: DataFrame, table: str, if_exists: str = "append") -> None:
        mode = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}[if_exists]
        df.write.mode(mode).parquet(self.path(table))

    def truncate(self, table: str) -> None:
        """Empty the table, keep its schema."""
        schema = CATALOG.get(table) or self.spark.read.parquet(self.path(table)).schema
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self.path(table))

    def csv_to_table(self, csv_path: str, table: str, if_exists: str = "replace") -> int:
        df = read_csv(self.spark, csv_path, CATALOG[table])
        self.write_df(df, table, if_exists)
        return self.read_table(table).count()

    # S12 / S13
    def row_counts(self, tables: list[str]) -> DataFrame:
        parts = [self.read_table(t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
                 for t in tables if self.exists(t)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def export_snapshots(self, out_root: str, tables: list[str], fmt: str = "parquet") -> list[str]:
        done = []
        for t in tables:
            if self.exists(t):
                self.read_table(t).write.mode("overwrite").format(fmt).option("header", True).save(f"{out_root}/{t}")
                done.append(t)
        return done


def verify_files_present(folder: str, required: list[str], optional: list[str] = ()) -> list[str]:
    """Raise listing every missing required file; return present optional ones."""
    missing = [f for f in required if not path_exists(f"{folder}/{f}")]
    if missing:
        raise FileNotFoundError(f"missing source files: {missing}")
    return [f for f in optional if path_exists(f"{folder}/{f}")]


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """schema'd CSV scan (BOM-safe: the header row is skipped, not parsed)."""
    return (spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE")
            .schema(schema).csv(path))


def optional_source(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An absent optional source is an empty DataFrame with its schema."""
    if not path_exists(path, spark):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_small(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Evaluation tables (bounded: a few hundred rows) as one file each."""
    df.coalesce(1).write.mode("overwrite").format(fmt).option("header", True).save(path)


def landed_series_payloads(series: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """The landed JSON payload shape of S17, built from a table: one payload
    per calendar month (each holds <= 31 observations, so no group grows
    with the data); a missing value becomes the '.' marker."""
    obs = F.struct(F.date_format(date_col, "yyyy-MM-dd").alias("date"),
                   F.coalesce(F.col(value_col).cast("string"), F.lit(".")).alias("value"))
    return (series.groupBy(F.trunc(date_col, "month").alias("month"))
                  .agg(F.to_json(F.struct(F.array_sort(F.collect_list(obs)).alias("observations"))).alias("payload")))
