"""Filter interaction audit: what each filter removes at each place of every order, by wide packed counters.

Every document gets a mask of the filters it fails. A mask alone decides what happens at all steps of all orders, so
each mask is mapped to one wide integer that has a field for every (order, step, outcome): 1 where that is the outcome,
0 elsewhere. For each part the integers are summed over its documents, once for all, once for those labelled good and
once for those labelled toxic, and the fields of the sums are the counts. No field can flow over into the next: a field
has as many bits as the part's number of documents needs, and no count is above that number.

Scale: documents are read once. What travels is a digest of the text, the id, the part and the mask; repeated rows are
counted in each task first, so that a text which a third of all documents share comes down to a row for each id and
then for each part. Labels meet ids, where rows without an id are spread by their digest. The integers are summed
over one row per part, mask and label, 128 rows a part at most, weighted by the number of documents.

Defined cases: a null text is empty; a null part is the empty string; a document without a label is neither good nor
toxic, one with labels that differ is what any of them says; rows that repeat a document count each; a row without doc_id has no
label, and is neither earlier nor later than any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithograph.llm.text import WORD, word_count

FILTERS = "ABCDE"
KEPT, REMOVED, REDUNDANT, UNIQUE = range(4)
OUTCOMES = 4
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text alone, each true where the text fails it."""
    n = word_count(text)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 100, "B": F.lit(100) * distinct < F.lit(80) * n, "C": F.lit(100) * capitals > F.lit(10) * F.length(text), "D": text.rlike("[#$%&*|]")}


def failure_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(part, digest, doc_id, mask, rows): documents by identical text and id, with bit i of mask set where the text alone fails filter i."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(fails, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0)) for name, fails in text_failures(F.col("text")).items()]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    digest = F.concat_ws("-", F.md5("text"), F.length("text"))
    return light.select("part", digest.alias("digest"), "doc_id", mask.alias("mask")).groupBy("part", "digest", "doc_id", "mask").agg(F.count("*").alias("rows"))


def with_labels(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """masks with good and toxic (0 or 1) of the document."""
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("key")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    keyed = masks.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none-"), "digest")))
    return keyed.join(said, "key", "left").drop("key").na.fill(0, ["good", "toxic"])


def with_duplicates(labelled: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents counted, with the bit of the duplicate filter set on those whose text a smaller id has.

    A group of equal texts first comes down to one row for each part and label, with its least id and the rows that have it.
    """
    kinds = ["part", "mask", "good", "toxic"]
    with_id = F.when(F.col("doc_id").isNotNull(), F.col("rows")).otherwise(0)
    groups = labelled.groupBy("digest", *kinds).agg(
        F.sum("rows").alias("all_rows"), F.sum(with_id).alias("id_rows"), F.min("doc_id").alias("least"), F.min_by("rows", "doc_id").alias("least_rows")
    )
    first = F.min("least").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    groups = groups.withColumn("later", F.col("id_rows") - F.when(F.col("least") == first, F.col("least_rows")).otherwise(0))
    split = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("all_rows") - F.col("later")).alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E"))).alias("mask"), F.col("later").alias("n")),
    )
    rows = groups.select("part", "good", "toxic", F.inline(split)).filter("n > 0")
    return rows.groupBy(*kinds).agg(F.sum("n").alias("n"))


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def place(order: int, step: int, outcome: int) -> int:
    """The field of an outcome at a step (from 0) of an order."""
    return (order * len(FILTERS) + step) * OUTCOMES + outcome


def wide_integer(mask: int, width: int) -> int:
    """One integer with fields of `width` bits: 1 in the field of each outcome of a document that fails the filters of mask."""
    fields = 0
    for o, order in enumerate(orders()):
        gone = False
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            if fails:
                fields |= 1 << width * place(o, s, REDUNDANT if gone else REMOVED)
            gone = gone or fails
            if not gone:
                fields |= 1 << width * place(o, s, KEPT)
            if mask == bit:
                fields |= 1 << width * place(o, s, UNIQUE)
    return fields


def unpack(total: int, width: int) -> list[int]:
    """All fields of a sum of wide integers."""
    ones = (1 << width) - 1
    return [total >> width * i & ones for i in range(place(len(orders()), 0, 0))]


def audit_part(rows: pd.DataFrame) -> pd.DataFrame:
    """The counts of one part, given its documents counted by mask and labels (a row each)."""
    width = int(rows["n"].sum()).bit_length()
    integers = {mask: wide_integer(mask, width) for mask in set(rows["mask"].tolist())}
    every, good, toxic = 0, 0, 0
    for mask, is_good, is_toxic, n in rows[["mask", "good", "toxic", "n"]].itertuples(index=False):
        added = integers[int(mask)] * int(n)
        every += added
        good += added if is_good else 0
        toxic += added if is_toxic else 0
    counts, good_counts, toxic_counts = (unpack(x, width) for x in (every, good, toxic))
    steps = [(o, order, s) for o, order in enumerate(orders()) for s in range(len(FILTERS))]
    shapley = dict.fromkeys(FILTERS, 0)
    for o, order, s in steps:
        shapley[order[s]] += counts[place(o, s, REMOVED)]
    name = rows["part"].iloc[0]
    return pd.DataFrame(
        [
            (name, order, s + 1, *(counts[place(o, s, x)] for x in (KEPT, REMOVED, REDUNDANT, UNIQUE)), good_counts[place(o, s, REMOVED)], toxic_counts[place(o, s, REMOVED)], shapley[order[s]])
            for o, order, s in steps
        ],
        columns=[c.split()[0] for c in AUDIT.split(", ")],
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return with_duplicates(with_labels(failure_masks(docs, part), labels)).groupBy("part").applyInPandas(audit_part, AUDIT)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [CASE WHEN len(words) < 100 THEN 'A' END,
          CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
          CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g'))) > 10 * length(text) THEN 'C' END,
          CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
          CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END] AS fails
  FROM texts LEFT JOIN said USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.x, b.x, c.x, d.x, e.x] AS f
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, f FROM orders),
groups AS (
  SELECT part, good, toxic, [x FOR x IN fails IF x IS NOT NULL] AS failed, count(*) AS n FROM judged GROUP BY ALL),
outcomes AS (
  SELECT part, filter_order, step, f[step] AS x, good, toxic, n, failed,
         list_contains(failed, f[step]) AS fails_here, list_has_any(failed, f[1:step - 1]) AS gone
  FROM groups, steps),
counts AS (
  SELECT part, filter_order, step::INT AS step, x,
         coalesce(sum(n) FILTER (NOT gone AND NOT fails_here), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND fails_here), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND fails_here), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = [x]), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND fails_here AND good = 1), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND fails_here AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM outcomes GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counts
"""
