"""Loading, windowed reading and writing of panel tables."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.windows import CODE, DATE, exchange_parts
from tidepanel.sources.naming import RAW_TO_PANEL
from tidepanel.sources.scratch import save

ORDINAL = "__ordinal"


def year_path(root: str, year: int, fmt: str) -> str:
    """Yearly CSV is a file (or a folder of part files) YYYY.csv; yearly Parquet is a partition folder."""
    return f"{root}/{year}.csv" if fmt == "csv" else f"{root}/year={year}"


def _read_year(spark: SparkSession, root: str, year: int, fmt: str) -> DataFrame | None:
    """One year, or None when it is absent. Rows carry their place in the load order."""
    path = year_path(root, year, fmt)
    try:
        reader = spark.read.option("header", True).option("encoding", "UTF-8")
        df = reader.csv(path) if fmt == "csv" else spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    # A byte-order mark belongs to the first header name, not to the data.
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})
    at = [F.lit(year).alias("year"), F.col("_metadata.file_name").alias("file")]
    if fmt == "csv":
        at += [F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    else:
        at += [F.lit(0).cast("long").alias("block"), F.col("_metadata.row_index").alias("row")]
    return df.withColumn(ORDINAL, F.struct(*at))


def scan_years(spark: SparkSession, root: str, start: int, end: int, fmt: str = "parquet") -> DataFrame:
    """All years in [start, end] that exist, united by column name; an error when there is none."""
    found = [df for y in range(start, end + 1) if (df := _read_year(spark, root, y, fmt)) is not None]
    if not found:
        raise FileNotFoundError(f"no yearly data below {root} for {start}..{end}")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def map_columns(df: DataFrame, mapping: dict[str, str] = RAW_TO_PANEL) -> tuple[DataFrame, list[str]]:
    """Rename what the mapping knows, keep the rest; also the measures that are missing."""
    missing = [v for k, v in mapping.items() if k not in df.columns and v not in (CODE, DATE)]
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns}), missing


def coerce_types(df: DataFrame) -> DataFrame:
    """date and code get their types; text measures become doubles, unparsable values NULL; NaN becomes NULL."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if f.name == DATE:
            c = c.cast("date") if kind != "string" else F.to_date(c)
        elif f.name == CODE:
            c = c.cast("string")
        elif f.name == ORDINAL:
            pass
        elif kind == "string":
            c = c.try_cast("double")
        if f.name not in (CODE, DATE, ORDINAL) and kind in ("string", "double", "float"):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def load_panel(spark: SparkSession, root: str, start: int, end: int, fmt: str = "parquet") -> DataFrame:
    """Scan, rename and coerce; market returns are joined by operators.market."""
    df, _missing = map_columns(scan_years(spark, root, start, end, fmt))
    return coerce_types(df)


def latest_date(spark: SparkSession, root: str, start: int, end: int, fmt: str = "parquet") -> DataFrame:
    """Newest day of the newest year that exists; only that year's date column is read."""
    for year in range(end, start - 1, -1):
        df = _read_year(spark, root, year, fmt)
        if df is not None:
            return df.select(F.to_date(DATE).alias(DATE)).agg(F.max(DATE).alias("latest_date"))
    raise FileNotFoundError(f"no yearly data below {root} for {start}..{end}")


def write_years(df: DataFrame, root: str, fmt: str = "parquet", keep_others: bool = False, on_code: bool = False) -> None:
    """One directory per year (year=YYYY, or YYYY.csv), rows sorted by (code, date).

    keep_others: Parquet years that df does not have stay as they are (CSV years always do). Codes are bucketed inside the year, so that every year is spread over all tasks.
    on_code: df is partitioned on the code, so that each task has rows of every year, and needs no other exchange.
    """
    out = df.withColumn("year", F.year(DATE))
    if not on_code:
        parts = exchange_parts(df)
        out = out.repartition(parts, "year", F.pmod(F.hash(CODE), F.lit(parts)))
    out = out.sortWithinPartitions("year", CODE, DATE)
    if fmt != "csv":
        mode = "dynamic" if keep_others else "static"
        out.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("year").parquet(root)
        return
    # Partition folders cannot be named YYYY.csv: the rows are written once, then each year (a dozen) by itself.
    out = save(out, "years")
    for r in out.select("year").distinct().collect():
        year = out.filter(F.col("year") == r["year"]).drop("year")
        year.write.mode("overwrite").option("header", True).csv(year_path(root, r["year"], fmt))


def year_exists(spark: SparkSession, root: str, year: int, fmt: str = "parquet") -> bool:
    """Whether a table written by write_years has the year; lists one directory, reads nothing."""
    try:
        spark.read.format("binaryFile").load(year_path(root, year, fmt))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def read_table_years(spark: SparkSession, root: str, years: Iterable[int], must_exist: bool, fmt: str = "parquet") -> DataFrame:
    """Pruned read of feature years. CSV columns get their types by coerce_types, labels that are counts become doubles."""
    years = list(years)
    present = [y for y in years if year_exists(spark, root, y, fmt)]
    if must_exist and len(present) < len(years):
        raise FileNotFoundError(f"feature years {sorted(set(years) - set(present))} are missing below {root}")
    if not present:
        raise FileNotFoundError(f"no feature year of {years} below {root}")
    if fmt == "csv":
        df = coerce_types(scan_years(spark, root, min(present), max(present), fmt))
        return df.withColumn("year", F.year(DATE)).filter(F.col("year").isin(present)).drop(ORDINAL)
    return spark.read.parquet(root).filter(F.col("year").isin(present))


def window_scan(spark: SparkSession, root: str, start: int, target: str, fmt: str = "parquet") -> DataFrame:
    """Two train years and one test year; all must exist; rows without a target are dropped."""
    df = read_table_years(spark, root, [start, start + 1, start + 2], must_exist=True, fmt=fmt)
    return df.filter(F.col(target).isNotNull())


def range_scan(spark: SparkSession, root: str, start: int, end: int, label: str, fmt: str = "parquet") -> DataFrame:
    """All feature years in the range that exist; the label column is required."""
    df = read_table_years(spark, root, range(start, end + 1), must_exist=False, fmt=fmt)
    if label not in df.columns:
        raise ValueError(f"label column {label!r} is not in the feature table")
    return df


def load_params(spark: SparkSession, inline: dict | None = None, path: str | None = None) -> dict:
    """Model parameters: the inline dict when given, else a JSON file; must be a non-empty dict."""
    if inline is not None:
        params = dict(inline)
    else:
        # Through Spark, so that the file may be in any store that the session reads; a few lines.
        params = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
    if not isinstance(params, dict) or not params:
        raise ValueError("model parameters must be a non-empty mapping")
    return params


def feature_list(spark: SparkSession, path: str, extra: Iterable[str], excluded: Iterable[str]) -> list[str]:
    """Feature names of a one-column CSV plus extras, first occurrence kept, exclusions removed."""
    names = [r["feature"] for r in spark.read.option("header", True).csv(path).select("feature").collect()]
    banned = set(excluded)
    return [n for n in dict.fromkeys([*names, *extra]) if n not in banned]
