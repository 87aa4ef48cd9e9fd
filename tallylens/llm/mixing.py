"""Mixing sources to target weights.

Every document gets a key by hashing its id and text size with a seed, so its
place is random but the same in every run. Within a source documents are sorted
by key: equal ranges of the key are the partitions of the sort, so a source that
holds a third of all rows is spread over ``RANGES`` of them. Prefix sums of the
sizes are taken in two steps, over the ranges of each source and inside each
range. A source that should give ``target`` words is read in whole rounds
(epochs) while the target covers it, and the last round is cut at the exact
word; the document at the cut gives the words in front of it.

Only ids, sources and sizes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallylens.llm.tables import pick
from tallylens.sources.files import staged

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3  # rounds of one source
RANGES = 4096  # three hexadecimal digits of the key


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size in words (null text: 0) and the key; ``place`` is the source as text that is never null."""
    return pick(docs, "doc_id", "text", "source").select("doc_id", "source", n_words(F.col("text")).alias("size")).select(
        "*", F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
        .alias("key"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("place"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """One row per source: place, source_size, target.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the sum
    of all sizes; a target stops at ``most`` times its source and the excess
    goes to the others by weight. That ends where each target is the smaller
    of its stop and ``level * weight``; the level follows from the order in
    which sources reach their stop. The rows are sources, not documents.
    """
    per = sizes.groupBy("place").agg(F.sum("size").alias("source_size"))
    by_name = W.partitionBy(F.lit(0)).orderBy("place")
    by_stop = W.partitionBy(F.lit(0)).orderBy(F.col("stop") / F.col("weight"), "place")
    before = by_stop.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    return (
        per.withColumn("weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1)
        .withColumn("stop", most * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0)))
                    / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        # the first source below its stop sets the level for itself and all after it
        .withColumn("free", F.col("level") * F.col("weight") < F.col("stop"))
        .withColumn("common", F.min(F.when(F.col("free"), F.struct(F.col("stop") / F.col("weight"), "place", "level"))).over(whole)["level"])
        .select("place", "source_size", F.when(F.col("common").isNull() | (F.col("stop") <= F.col("common") * F.col("weight")),
                                               F.col("stop").cast("double")).otherwise(F.col("common") * F.col("weight")).alias("target")))


def mix(docs: DataFrame, most: int = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken``, the words the mix takes, for every document.

    Documents without words give none. Rows with equal ids and sizes are told
    apart by nothing, so either may be the one at the cut.
    """
    rows = staged(sized(docs, seed), "mix_sizes")
    goal = targets(rows, most)
    slot = F.substring("key", 1, 3)
    in_front = W.partitionBy("place").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy("place", slot.alias("slot")).agg(F.sum("size").alias("held"))
        .withColumn("start", F.coalesce(F.sum("held").over(in_front), F.lit(0)))
        .join(goal, "place").select("place", "slot", "start", "source_size", "target"))
    inside = W.partitionBy("place", "slot").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    budget = F.floor(F.col("target"))
    rest = F.pmod(budget, F.greatest(F.col("source_size"), F.lit(1)))
    rounds = F.when(F.col("source_size") > 0, (budget - rest) / F.col("source_size")).otherwise(0).cast("long")
    ahead = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        rows.withColumn("slot", slot).join(starts, ["place", "slot"])
        .withColumn("ahead", ahead)
        .select("doc_id", "source", "size", "source_size", "target",
                (rounds * F.col("size") + F.least(F.greatest(rest - F.col("ahead"), F.lit(0)), F.col("size"))).alias("taken")))


SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
keyed AS (SELECT *, md5('mix/' || coalesce(doc_id::VARCHAR, '') || '/' || size) AS key FROM sized),
per AS (SELECT place, sum(size)::BIGINT AS source_size FROM sized GROUP BY place),
weighed AS (SELECT *, (row_number() OVER (ORDER BY place) - 1) % 3 + 1 AS weight, 3 * source_size AS stop FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY stop / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT first(level ORDER BY stop / weight, place) AS level FROM levels WHERE level * weight < stop),
goals AS (
  SELECT place, source_size,
         CASE WHEN c.level IS NULL OR stop <= c.level * weight THEN stop::DOUBLE ELSE c.level * weight END AS target
  FROM levels, common c),
placed AS (
  SELECT k.*, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY place ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM keyed k JOIN goals g USING (place))
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
             + least(greatest(budget % source_size - ahead, 0), size) END)::BIGINT AS taken
FROM placed
"""
