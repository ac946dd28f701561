"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; row r of a source of n rows has the fractional rank
(2 r + 1) / (2 n). All rows are sorted by fractional rank, so that sources interleave in proportion, and the order is cut
into shards whose row counts differ by one at most. Any stretch of the order holds every source in its share of the corpus,
and so does every shard; a slot is the row's place in its shard.

Scale: only ids, sizes and hashes are ranked; a text moves once, when shards are written. A rank is never taken over a
whole source: draws and fractional ranks are spread evenly over [0, 1), so each is cut into about sqrt(n) equal
ranges, rows are counted by range, ranges add up the counts before them, and rows are ranked inside their range.

Defined cases: a null text has no bytes and CRC 0; a null source is a source of its own, ranked first; rows without doc_id and
rows that repeat another's source, doc_id and text are numbered, and each number draws for itself, so that copies are spread; an
empty table gives no rows; with more shards than rows some shards are empty; extra columns are ignored, and kept by write_shards (but for own ones named shard or slot, which are written anew).
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithograph.session import materialize

SHARDS = 24
LAW = "rows"
CHUNK = 1 << 16
KEY = ("stratum", "id_key", "size", "text_crc32")


def ranked(rows: DataFrame, group: list[str], span: str, order: list[str], name: str) -> DataFrame:
    """rows with `name` = 0, 1, .. inside each group, in the order of (span, order), where span numbers consecutive ranges.

    Rows meet only those of their own range; what is before it is one count per range.
    """
    keys = [*group, span]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return rows.join(offsets, keys).withColumn(name, F.col("_before") + F.row_number().over(inside) - 1).drop("_before")


def draw(seed: int) -> Column:
    """A hash of the row's key and copy as a number from 0 to 2^48 - 1."""
    hashed = F.md5(F.concat_ws("-", "id_key", "size", "text_crc32", "copy", F.lit(str(seed))))
    return F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long")


def light_rows(docs: DataFrame, tag: Column) -> DataFrame:
    """What ranks need of a document: tag (a number of its own), doc_id, stratum, id_key, size and text_crc32."""
    text = F.col("text").cast("binary")
    return docs.select(
        tag.alias("tag"), "doc_id",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("stratum"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("id_key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )


def numbered_copies(light: DataFrame) -> DataFrame:
    """light with copy = 0, 1, .. among rows of the same key; only rows whose key is there twice are numbered, by chunks of their tags."""
    twice = light.groupBy(*KEY).agg(F.count("*").alias("_copies")).filter("_copies > 1")
    told = materialize(light.join(twice, list(KEY), "left"), "shard-copies")
    single = told.filter("_copies IS NULL").withColumn("copy", F.lit(0).cast("long"))
    several = told.filter("_copies IS NOT NULL").withColumn("_chunk", F.floor(F.col("tag") / CHUNK))
    return single.unionByName(ranked(several, list(KEY), "_chunk", ["tag"], "copy").drop("_chunk")).drop("_copies")


def assign(light: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """light with stratum_rank, position in the interleaved order, shard and slot."""
    copies = numbered_copies(light).withColumn("draw", draw(seed))
    drawn = materialize(copies, "shard-draws")
    sizes = drawn.groupBy("stratum").agg(F.count("*").alias("stratum_rows"))
    total = drawn.count()
    spans = max(1, isqrt(total))
    drawn = drawn.withColumn("_span", F.floor(F.col("draw") * F.lit(float(spans)) / F.lit(float(1 << 48))))
    first = ranked(drawn, ["stratum"], "_span", ["draw", "id_key", "size", "text_crc32", "copy"], "stratum_rank").drop("_span")
    first = materialize(first.join(sizes, "stratum"), "shard-ranks")
    share = (2 * F.col("stratum_rank") + 1).cast("double") / (2 * F.col("stratum_rows")).cast("double")
    spread = first.withColumn("share", share).withColumn("_all", F.lit(0)).withColumn("_span", F.floor(F.col("share") * F.lit(float(spans))))
    placed = ranked(spread, ["_all"], "_span", ["share", "stratum", "stratum_rank"], "position")
    shard = F.expr(f"position * {shards} div {max(total, 1)}")
    begin = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - begin).select(
        "tag", "doc_id", "stratum", "stratum_rank", "size", "text_crc32", "position", "shard", "slot"
    )


def shard_places(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, stratum, size, text_crc32, position, shard and slot, without its text."""
    return assign(materialize(light_rows(docs, F.monotonically_increasing_id()), "shard-rows"), shards, seed).drop("tag")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 42, file_rows: int = 100_000) -> DataFrame:
    """Writes docs with shard and slot as Parquet, a folder per shard, files in the order of slots, and returns what was written.

    Rows are written once with their tags, so that a task which is run again finds the same tags.
    """
    own_tag = F.monotonically_increasing_id().alias("own_tag")
    held = materialize(docs.select(own_tag, "doc_id", "source", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")), "shard-texts")
    light = light_rows(held, F.col("own_tag"))
    places = materialize(assign(materialize(light, "shard-rows"), shards, seed).select("tag", "shard", "slot"), "shard-places")
    files = max(shards, -(-places.count() // file_rows))
    columns = [F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    whole = held.join(places, F.col("own_tag") == F.col("tag")).select(*columns, "shard", "slot")
    whole.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is `rows`)."""
    places = shard_places(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return places.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT n::BIGINT AS n, n::BIGINT AS c, 0 AS k FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS entry FROM steps WHERE k = 8),
sized AS (
  SELECT doc_id, coalesce('s' || source, '') AS stratum, coalesce(doc_id::VARCHAR, 'none') AS id_key,
         (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size,
         xor(4294967295::BIGINT, list_reduce(
           [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')],
           lambda a, b: xor(a >> 8, entry[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM documents, crc),
copies AS (SELECT *, row_number() OVER (PARTITION BY stratum, id_key, size, text_crc32) - 1 AS copy FROM sized),
drawn AS (
  SELECT *, ('0x' || substr(md5(id_key || '-' || size || '-' || text_crc32 || '-' || copy || '-42'), 1, 12))::BIGINT AS draw FROM copies),
first AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw, id_key, size, text_crc32, copy) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n FROM drawn),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, stratum, r) - 1 AS position, count(*) OVER () AS total FROM first)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * 24 // total)::INT AS shard,
       (position - ((position * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""
