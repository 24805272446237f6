"""Operator 3: mixing sources to target weights by systematic sampling.

Within a source every document has the same number of expected copies, target / source size. Documents are put in
an order (size class, salt, size, id), their expected copies are summed along it, one offset per source is added, and a
document is emitted once for each integer that its interval crosses. Ordering by size first makes the words taken
follow the target closely. The running position comes from counts of bounded cells (source, class, salt), so a source
with a third of all rows is never in one task.

Null text has size 0; a null source is a source of its own, the last one. Repeated ids share their decision's inputs
and are ordered arbitrarily but equally; null ids come last in an order, and ``mix`` takes them as documents each; extra columns pass through ``mix``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import WORD, bare, row_key, stored

#: No document is taken more often than this, so no target is above this many times its source's size.
MOST = 3
_KEY = "coalesce(concat('s', source), 'n')"


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: its size, weight and target.

    Targets are min(level * weight, MOST * size), the level being such that they add up to all sizes: the fixed point
    of resharing what is above the caps. The level's interval is found from running sums over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code = W.orderBy(F.expr("source is null"), F.encode("source", "UTF-8"))
    per = per.withColumn("weight", (F.row_number().over(by_code) - 1) % 3 + 1)
    everything = W.partitionBy()
    upto = W.orderBy(F.col("source_size") / F.col("weight"), F.expr("source is null"), "source").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - MOST * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    per = per.withColumn("_level", level).withColumn("_capped", F.col("_level") * F.col("weight") > MOST * F.col("source_size"))
    last = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(everything)
    return per.select("source", "source_size", "weight", F.least(last * F.col("weight"), (MOST * F.col("source_size")).cast("double")).alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, source, size, source_size, target, copies) for every row: how often the mix takes it."""
    sized = docs.select(id_col, "source", F.regexp_count(bare(F.col("text")), F.lit(WORD)).cast("long").alias("size"))
    sized = sized.withColumns({
        "_key": F.expr(_KEY),
        "_class": F.floor(F.sqrt("size")).cast("int"),
        "_salt": F.coalesce(F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 2), 16, 10).cast("int"), F.lit(256)),
    })
    sized = stored(sized, "mixing-sizes")  # texts are read once
    cell = ["_key", "_class", "_salt"]
    cells = sized.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    inner = W.partitionBy("_key", "_class").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    classes = cells.groupBy("_key", "_class").agg(F.sum("n").alias("n"))
    outer = W.partitionBy("_key").orderBy("_class").rowsBetween(W.unboundedPreceding, -1)
    classes = classes.select("_key", "_class", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("_before"))
    before = cells.withColumn("_inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(classes, ["_key", "_class"])
    before = before.select(*cell, (F.col("_before") + F.col("_inner")).alias("_before"))
    rank = F.row_number().over(W.partitionBy(*cell).orderBy("size", F.asc_nulls_last(id_col)))
    ranked = sized.withColumn("_rank", rank).join(before, cell).withColumn("_rank", F.col("_before") + F.col("_rank"))
    goal = targets(sized).withColumn("_key", F.expr(_KEY)).drop("source")
    # a row for each source; beyond the session's broadcast threshold Spark joins by shuffling and splits hot keys
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.col("_key").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    taken = F.floor(rate * F.col("_rank") + offset) - F.floor(rate * (F.col("_rank") - 1) + offset)
    out = ranked.join(goal, "_key").withColumn("copies", F.least(taken, F.lit(MOST)))
    return out.select(id_col, "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: every column of ``docs``, each row as often as it is taken."""
    docs_ = docs.withColumn("_row", row_key())
    often = copies(docs_, "_row").groupBy("_row").agg(F.max("copies").alias("_copies"))
    out = docs_.join(often.where("_copies > 0"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
p AS (SELECT source, k, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source, k),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM p),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
        - 3 * coalesce(sum(source_size) OVER u, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER u, 0)) AS level
      FROM w WINDOW u AS (ORDER BY source_size / weight, source IS NULL, source
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size,
        least(max(CASE WHEN level * weight <= 3 * source_size THEN level END) OVER () * weight,
              CAST(3 * source_size AS DOUBLE)) AS target FROM l),
r AS (SELECT s.doc_id, s.k, s.size, row_number() OVER (PARTITION BY s.k ORDER BY floor(sqrt(size)),
        ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2))::INT, size, doc_id) AS pos FROM s),
c AS (SELECT r.*, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0.0) AS rate,
        CAST(('0x' || substr(md5(r.k), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS off
      FROM r JOIN t USING (k))
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(rate * pos + off) - floor(rate * (pos - 1) + off), 3) AS BIGINT) AS taken
FROM c
"""
