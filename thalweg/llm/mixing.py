"""Mixing sources to target weights by hash order, distributed prefix sums and exact cuts.

Every document gets a hash-random key, of its doc_id and text, so that null and repeated doc_ids spread. Within a source the keys are cut into ranges of about RANGE
documents; sums of ranges, of groups of ranges, and of sources are prefix-summed one level at a time,
so no window ever holds more than about RANGE documents or FAN ranges, whatever a source's share. A
source takes whole epochs of its documents first and then, in key order, words up to its exact budget
(the floor of its target); the document at the cut gives only the words that still fit.

Targets: sources in code-point order (null last) weigh WEIGHTS, repeating, and share all words; a
target above CAP times its source's words stops there and the excess is shared by weight among the
rest until none is above. Null and empty texts have size 0 and give 0 words. Repeated rows are rows
of their own; ties of the key go by doc_id, then size. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS, CAP, RANGE, FAN = (5, 2, 1), 3, 64, 1024
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources(source, n_docs, source_size), one row each → plus src, weight and target.

    One row per source, so the unpartitioned windows are over the list of sources alone.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("src", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(everything))
    # sources fill up in the order of cap / weight
    by_fill = Window.orderBy((F.col("cap") / F.col("weight")), "src")
    w = w.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("full", F.col("weight") * (F.col("total") - F.col("cap_before")) > F.col("cap") * F.col("weight_left"))
    w = w.withColumn("rest", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
    w = w.withColumn("rest_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    share = (F.col("weight") * F.col("rest")).cast("double") / F.col("rest_weight")
    return w.select("source", "src", "n_docs", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs(doc_id, text, source)."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key")), "sizes")
    sources = cut(source_targets(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), weights, cap), "sources")
    s = sources.select(F.col("source").alias("of"), "src", "source_size", "target", F.ceil(F.col("n_docs") / RANGE).alias("ranges"))
    placed = sized.join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.withColumn("at", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / (1 << 32)).cast("long")).drop("ranges")

    def before(by: Window) -> Column:
        return F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = cut(placed.groupBy("src", "at").agg(F.sum("size").alias("size")).withColumn("group", F.floor(F.col("at") / FAN)), "ranges")
    groups = ranges.groupBy("src", "group").agg(F.sum("size").alias("size")).select("src", "group", before(Window.partitionBy("src").orderBy("group")).alias("group_before"))
    ranges = ranges.withColumn("range_before", before(Window.partitionBy("src", "group").orderBy("at"))).join(groups, ["src", "group"]).select("src", "at", (F.col("range_before") + F.col("group_before")).alias("range_before"))
    inner = placed.withColumn("in_range", before(Window.partitionBy("src", "at").orderBy("key", "doc_id", "size")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("range_before") - F.col("in_range")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", left))
    return inner.join(ranges, ["src", "at"]).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS src FROM per),
weighed AS (SELECT *, CASE src % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM ranked),
filled AS (
  SELECT *, weight * (total - coalesce((sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
    > cap * (sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS is_full FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
    (weight * (total - (sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::BIGINT))::DOUBLE / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::BIGINT END AS target FROM filled),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
    coalesce((sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - done)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""
