"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number in (0, 1) from the hash of (key, shard); the shard with the largest weight / -ln(number) takes the record.
Key and shards alone decide, so one more shard takes records only into itself, about its share of them, and one less only spreads its own.
A third of all rows under one key go to one shard: that is what a key rule means; their slots are still counted in many tasks.

Slots number the records of a shard without gaps. Rows are range-partitioned on (shard, key, hash of the text), numbered inside a
partition, and offset by the counts of the partitions before, so no task holds a whole shard. Null keys count as one key, written
"null". Equal rows get different slots; which of them gets which is arbitrary but the rows are equal. Other columns pass through write_shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.ordered import ordered_running_sum
from tidepanel.llm.words import text_of

#: Hex digits of the digest that make the number: 52 bits, exact in a double.
DIGITS = 13


def shard_of(key: Column, weights: dict[int, float]) -> Column:
    """Shard of a record; weights: shard -> weight over 0. Ties go to the smaller shard."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need weights over 0")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    same = len(set(weights.values())) == 1

    def bid(shard: int, weight: float) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{shard}"))), 1, DIGITS), 16, 10).cast("long")
        # Among equal weights the largest number wins, and no logarithm is needed.
        value = drawn if same else F.lit(float(weight)) / -F.ln((drawn + 0.5) / float(16**DIGITS))
        return F.struct(value.alias("bid"), F.lit(-shard).alias("minus"))

    bids = [bid(k, w) for k, w in sorted(weights.items())]
    return (-(F.greatest(*bids) if len(bids) > 1 else bids[0])["minus"]).cast("int")


def even(shards: int) -> dict[int, float]:
    return dict.fromkeys(range(shards), 1.0)


def assign(docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot, grown_shard (null without `grown`)."""
    text = text_of()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        (shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    slots = ordered_running_sum(rows, ["shard"], order, {"slot": F.lit(1)}, task_rows=0)
    return slots.withColumn("slot", (F.col("slot") - 1).cast("long"))


def write_shards(docs: DataFrame, path: str, weights: dict[int, float], files: int = 8) -> None:
    """All columns of docs as Parquet, one folder per shard, `files` tasks to a shard."""
    dealt = docs.withColumn("shard", shard_of(F.col("doc_id"), weights))
    part = F.pmod(F.xxhash64("doc_id", text_of()), F.lit(files))
    dealt.withColumn("__f", part).repartition(len(weights) * files, "shard", "__f").drop("__f").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str, shards: int = 16) -> DataFrame:
    """op4: 16 shards of one weight; grown_shard is the shard among 17."""
    rows = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), even(shards), even(shards + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


SQL = """
WITH b AS (
  SELECT doc_id, s, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(s AS VARCHAR)), 1, 13) AS BIGINT) AS bid
  FROM documents, (SELECT unnest(range(17)) AS s)),
k AS (SELECT doc_id, arg_max(s, bid) FILTER (s < 16) AS shard, arg_max(s, bid) AS grown_shard FROM b GROUP BY doc_id),
c AS (
  WITH RECURSIVE r(i, k, t) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END FROM r WHERE k < 8)
  SELECT list(t ORDER BY i) AS v FROM r WHERE k = 8),
x AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, v,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS u
  FROM documents, c),
z AS (
  SELECT doc_id, bytes + 1 AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), u), lambda a, y: xor(a >> 8, v[1 + (xor(a, y) & 255)])), 4294967295) AS text_crc32
  FROM x)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM z JOIN k USING (doc_id)
"""
