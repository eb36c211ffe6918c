"""Exact deduplication by a stateful stream: disk-backed state by digest, no expiry, full bytes checked on hits.

Documents are landed as fingerprints: digest of the normalised text, stable identifier, length, and the locator (file and row) of the
content. A streaming aggregation reads them in micro-batches and keeps, for each digest and for good, the row that stays and the number
of rows; the state lives in RocksDB and its changes in the checkpoint folder, so a lost executor or a restart goes on from the last batch.
When the input is read to its end, the state is read as a table. Digests with more than one row are hits: their texts are fetched
again by locator and their full bytes compared. Texts that share a digest but not the bytes are then told apart by the bytes.
Native expressions only.

The normalised text has no blanks, tabs and line ends; null counts as empty. Of equal texts the row with the most code points in
the original text stays, then the smallest doc_id (null last), then the first by locator. Repeated rows count as copies. An empty table
gives an empty result. A hot digest is combined in each task before the exchange, and is an ordinary key of a join that may be split.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.words import fresh, text_of
from tidepanel.sources.scratch import folder, save

#: Bytes of landed fingerprints that a micro-batch takes.
BATCH_BYTES = 256 << 20
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # Else each of a task's stores sets aside some MB of disk that it never fills.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame, file: str = "__file", row: str = "__row") -> DataFrame:
    """docs with the file and row number of each row; docs that are no file scan are written first."""
    place = {file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")}
    try:
        return docs.withColumns(place)
    except AnalysisException:
        return save(docs, "documents").withColumns(place)


def fingerprints(docs: DataFrame, digest=sha256) -> DataFrame:
    """digest, doc_id, chars, file, row. Plain expressions, so docs may be a stream as well."""
    return docs.select(
        digest(normalised(text_of())).alias("digest"), "doc_id", F.length(text_of()).alias("chars"),
        F.col("__file").alias("file"), F.col("__row").alias("row"),
    )


def _order() -> Column:
    """Smallest: the row that stays."""
    return F.struct(
        (-F.col("chars")).alias("minus"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "file", "row"
    )


def keyed_state(spark: SparkSession, path: str, schema, checkpoint: str) -> DataFrame:
    """Runs the stream over what is landed at `path` and returns its state: digest, best, n.

    Called again with the same checkpoint, it takes only files that are new, and the state goes on.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        landed = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(path)
        states = landed.groupBy("digest").agg(F.min(_order()).alias("best"), F.count(F.lit(1)).alias("n"))
        run = states.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
        run.option("checkpointLocation", checkpoint).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    state = spark.read.format("statestore").load(checkpoint)
    best, n = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.{best}").alias("best"), F.col(f"value.{n}").alias("n"))


def classes(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per document: doc_id, file, row, digest, best (the row that stays), n (rows of the class), part (null, or the bytes' own class)."""
    spark = docs.sparkSession
    docs = docs if "__file" in docs.columns else located(docs)
    prints = save(fingerprints(docs, digest), "fingerprints")
    if prints.isEmpty():
        return prints.select("doc_id", "file", "row", "digest", _order().alias("best"), F.lit(1).cast("long").alias("n"))
    state = keyed_state(spark, prints.inputFiles()[0].rsplit("/", 1)[0], prints.schema, f"{folder(spark)}/state-{uuid.uuid4().hex}")
    all_ = save(prints.join(state, "digest").select("doc_id", "file", "row", "digest", "chars", "best", "n"), "classes")
    # Full bytes of the hits. The two extremes of a class are equal only if all of it is; they are combined before the exchange.
    hits = all_.filter("n > 1").select("digest", "file", "row")
    texts = docs.select(F.col("__file").alias("file"), F.col("__row").alias("row"), "text")
    full = texts.join(hits, ["file", "row"]).select("digest", normalised(text_of()).alias("bytes"))
    ends = full.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    unlike = save(ends.filter("low <> high").select("digest"), "collisions")
    if unlike.isEmpty():
        return all_
    # Some digest stands for several texts: those classes are formed by the bytes themselves.
    told = texts.join(all_.join(unlike, "digest", "left_semi"), ["file", "row"]).withColumn("bytes", normalised(text_of()))
    own = told.groupBy("digest", "bytes").agg(F.min(_order()).alias("best"), F.count(F.lit(1)).alias("n"))
    apart = told.drop("best", "n", "text").join(own, ["digest", "bytes"]).select(*all_.columns)
    return all_.join(unlike, "digest", "left_anti").unionByName(apart)


def _stays() -> Column:
    return (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))


def keep_rows(docs: DataFrame, gone) -> DataFrame:
    """docs less the rows that gone(doc_id and text of docs) lists by file and row."""
    file, row, f, r = (fresh(docs, n) for n in ("file", "row", "gone_file", "gone_row"))
    columns = docs.columns
    docs = located(docs, file, row)
    lost = gone(docs.select("doc_id", "text", F.col(file).alias("__file"), F.col(row).alias("__row"))).select(F.col("file").alias(f), F.col("row").alias(r))
    return docs.join(lost, (F.col(file) == F.col(f)) & (F.col(row) == F.col(r)), "left_anti").select(*columns)


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return keep_rows(docs, lambda d: classes(d).filter(~_stays()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: one row per document, dropped ones too."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), _stays().alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept,
  sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id)
"""
