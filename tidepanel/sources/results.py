"""Readers for model predictions and the market series, and writers for result tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.ordered import exact_quantile
from tidepanel.functions.windows import CODE, DATE

PREDICTION_SCHEMA = "code STRING, date DATE, return DOUBLE, y_true INT, y_prob DOUBLE, y_pred INT"


def read_predictions(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Predictions of all windows; the window tag is the directory name (`window=` partition or plain)."""
    if fmt == "csv":
        df = spark.read.schema(PREDICTION_SCHEMA).option("header", True).csv(f"{root}/*/predictions.csv")
        tag = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/predictions\.csv", 1)
        return df.withColumn("window", F.regexp_replace(tag, "^window=", ""))
    return spark.read.parquet(root).withColumn("window", F.col("window").cast("string"))


def merge_predictions(df: DataFrame) -> DataFrame:
    """One row per (code, date): that of the earliest window.

    min_by keeps one row per key while combining map-side, so copies of a key never meet in one task.
    """
    rest = [c for c in df.columns if c not in (CODE, DATE)]
    kept = df.groupBy(CODE, DATE).agg(F.min_by(F.struct(*rest), F.col("window")).alias("__r"))
    return kept.select(CODE, DATE, *[F.col(f"__r.{c}").alias(c) for c in rest])


def market_series_from_files(df: DataFrame, file_col: str, value: str, order: str | None = None) -> DataFrame:
    """First value per (file, date) by `order` (the value itself when not given), then the median over files per date."""
    known = F.when(F.col(value).isNotNull(), F.col(order or value))
    first = df.groupBy(file_col, DATE).agg(F.min_by(value, known).alias("__v"))
    median = exact_quantile(first, [DATE], "__v", 0.5, value)
    return first.select(DATE).distinct().join(median, DATE, "left")


def read_market_series(spark: SparkSession, root: str, value: str = "market_return_fwd", fmt: str = "parquet") -> DataFrame:
    """The cached series when it exists, else derived from every feature file below root (Parquet, or yearly CSV)."""
    try:
        cached = spark.read.option("header", True).csv(f"{root}/market_return_series.csv")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        return cached.select(F.to_date(DATE).alias(DATE), F.col(value).try_cast("double").alias(value))
    if fmt == "csv":
        files = spark.read.option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(root)
    else:
        files = spark.read.parquet(root)
    if value not in files.columns or DATE not in files.columns:
        raise FileNotFoundError(f"no file below {root} has {DATE} and {value}")
    order = F.col(CODE).cast("string") if CODE in files.columns else F.lit("")
    files = files.select(
        order.alias(CODE), F.to_date(DATE).alias(DATE), F.col(value).try_cast("double").alias(value), F.col("_metadata.file_path").alias("__file")
    )
    return market_series_from_files(files, "__file", value, CODE)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    out = df.write.mode("overwrite")
    if by:
        out = out.partitionBy(by)
    out.option("header", True).format(fmt).save(path)
