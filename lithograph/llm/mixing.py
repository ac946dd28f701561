"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each source gets a token target. Targets share `share` times all tokens by weight; none goes above `most` times its
source, and what is above is shared again by weight. A source takes its documents in whole epochs as long as its
target holds one; the rest of the target goes to a weighted sample without replacement: every document draws an
exponential key -ln(u) / weight, and documents are taken in the order of their keys until the prefix sum of their sizes
reaches the budget. The document at the boundary is taken in part.

Scale: the prefix sum never sorts a source in one task. Keys are cut into `buckets` ranges per source; sums per range
find the one range that holds the boundary, and only its documents are sorted. What comes out is one row per source
(its cut), so that documents join a table of one row per source.

Defined cases: a null text has size 0, a null source is a source of its own, ranked last. Rows that agree in id and size
draw the same key and share what is left at a cut evenly. An empty table gives an empty mix. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.llm.text import word_count
from lithograph.session import materialize

SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """1 for plain prose, falling to 0.1 as one character in eleven or more is a symbol."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    share = symbols.cast("double") / F.greatest(n, F.lit(1)).cast("double")
    return F.coalesce(F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(10.0) * share), F.lit(1.0))


def sampling_key(doc_id: Column, size: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) drawn from an MD5 of id, size and seed, so that reruns agree."""
    drawn = F.md5(F.concat_ws("-", F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"), F.lit(str(seed))))
    u = (F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**12))
    return -F.ln(u) / weight


def keyed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """docs with mix_size and mix_key."""
    return docs.withColumn("mix_size", word_count(F.col("text"))).withColumn(
        "mix_key", sampling_key(F.col("doc_id"), F.col("mix_size"), quality_weight(F.col("text")), seed)
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for sizes (source, mix_size).

    The windows without a partition run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.lit(most) * F.col("source_size"))
    rising = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.lit(share) * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("total", total).withColumn("full", left * F.col("w") >= F.col("cap") * left_w)
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    rest_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * rest / rest_w)
    return per.select("source", "source_size", F.round(target, 6).alias("target"))


def source_cuts(light: DataFrame, targets: DataFrame, buckets: int = 4096) -> DataFrame:
    """targets with whole epochs, and the key at which the fractional epoch ends and what each row there adds."""
    goals = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    bucket = F.floor(F.lit(float(buckets)) * (F.lit(1.0) - F.exp(-F.col("mix_key")))).cast("int")
    rows = light.select("source", "mix_key", "mix_size", bucket.alias("bucket"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("mix_size").alias("in_bucket"))
    along = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("ahead", F.sum("in_bucket").over(along) - F.col("in_bucket"))
    edge = sums.alias("b").join(goals.select("source", "rest").alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
    edge = edge.filter("ahead <= rest AND rest < ahead + in_bucket").select("b.source", "bucket", "ahead", "rest")
    near = rows.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bucket") == F.col("e.bucket")))
    near = near.groupBy("r.source", "mix_key", "ahead", "rest").agg(F.sum("mix_size").alias("here"), F.count("*").alias("rows_here"))
    order = Window.partitionBy("source").orderBy("mix_key")
    near = near.withColumn("ahead", F.col("ahead") + F.sum("here").over(order) - F.col("here"))
    cut = near.filter("ahead <= rest AND rest < ahead + here").select(
        F.col("source").alias("cut_source"), F.col("mix_key").alias("cut_key"), F.floor((F.col("rest") - F.col("ahead")) / F.col("rows_here")).cast("long").alias("cut_take")
    )
    return goals.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_take")


def taken_words() -> Column:
    """Words the mix takes of a row of keyed documents joined with its source's cut."""
    part = F.when(F.col("mix_key") < F.col("cut_key"), F.col("mix_size")).when(
        F.col("mix_key") == F.col("cut_key"), F.least(F.col("mix_size"), F.col("cut_take"))
    )
    return F.col("mix_size") * F.col("epochs") + F.coalesce(part, F.lit(0))


def join_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with the cut of their source; the cuts are one row per source, and Spark decides by their size how to join."""
    c = cuts.withColumnRenamed("source", "cut_source")
    return rows.join(c, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    light = materialize(keyed(docs.select("doc_id", "source", "text"), seed).select("doc_id", "source", "mix_size", "mix_key"), "mix-sizes")
    cuts = materialize(source_cuts(light, source_targets(light)), "mix-cuts")
    return join_cuts(light, cuts).select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", taken_words().cast("long").alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mixed corpus: docs' own columns, a document once for each copy taken; one cut to under half is left out."""
    held = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", "text")
    rows = keyed(held, seed).select("doc", "source", "mix_size", "mix_key")
    light = materialize(rows.select("source", "mix_size", "mix_key"), "mix-sizes")
    cuts = materialize(source_cuts(light, source_targets(light)), "mix-cuts")
    copies = F.round(taken_words() / F.greatest(F.col("mix_size"), F.lit(1))).cast("int")
    taken = join_cuts(rows, cuts).withColumn("copies", copies).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(greatest(0.1::DOUBLE, 1.0::DOUBLE - 10.0::DOUBLE * ((length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / greatest(length(text), 1)::DOUBLE)), 1.0::DOUBLE) AS weight
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '-' || size || '-42'), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / weight AS k
  FROM sized),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w
  FROM keyed GROUP BY source),
caps AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS all_w FROM per),
filled AS (
  SELECT *, (total - coalesce(sum(cap) OVER o, 0)) * w >= cap * (all_w - coalesce(sum(w) OVER o, 0)) AS is_full
  FROM caps WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         round(CASE WHEN is_full THEN cap ELSE w * (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (), 0) END, 6) AS target
  FROM filled),
cuts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goals),
tied AS (SELECT source, k, sum(size) AS here, count(*) AS rows_here FROM keyed GROUP BY source, k),
ahead AS (SELECT *, sum(here) OVER (PARTITION BY source ORDER BY k) - here AS ahead FROM tied)
SELECT d.doc_id, d.size, c.source_size, c.target,
       (d.size * c.epochs + least(d.size, greatest(0, floor((floor(c.target - c.epochs * c.source_size) - a.ahead) / a.rows_here))))::BIGINT AS taken
FROM keyed d
JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
JOIN ahead a ON d.source IS NOT DISTINCT FROM a.source AND d.k = a.k
"""
