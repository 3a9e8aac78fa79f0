"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwise.functions.ranking import with_global_index
from arcwise.llm.tables import WORD, keyed_rows, parted, read
from arcwise.storage import materialize


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from ``source`` and ``size``.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` (a fraction) of all sizes. A target stops at ``most`` times its
    source's size and the excess is shared anew. At the end the open sources have
    targets in proportion to their weights and every full one has a smaller
    limit a weight than they: so sources are taken in the order of that limit,
    and the first with room under the level of the rest sets the level. The
    windows run over one row per source, in one task: sources are meant to be
    few beside documents, and a million of them are some 50 MB there. An empty table gives no rows.
    """
    up, down = share
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    named = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    turn = F.array(*map(F.lit, weights))[(F.row_number().over(named) - 1) % len(weights)]
    per = per.select("*", turn.cast("long").alias("w"))
    full = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"), F.asc_nulls_last("source"))
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    per = per.select(
        "*",
        (up * F.sum("source_size").over(everything) - down * most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("rest"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open_w"),
    )
    # the level is rest / open_w / down a unit of weight, if no source before has it under its limit
    stops = F.col("rest") * F.col("w") <= F.col("source_size") * most * down * F.col("open_w")
    per = per.select("*", F.min(F.when(stops, F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", "rest", "open_w"))).over(everything).alias("level"))
    level = F.col("w") * F.col("level.rest") / (F.col("level.open_w") * down)
    limit = (F.col("source_size") * most).cast("double")
    return per.select("source", "source_size", "docs", F.least(limit, F.coalesce(level.cast("double"), limit)).alias("target"))


def offset(source, seed: int, steps: int = 4096) -> F.Column:
    """A fraction of 1 for each source; few binary digits keep whole ratios exact."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("double") / steps


def copies_per_document(rows: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Add ``copies`` to ``doc_id, source, size``: how often the mix takes each.

    All documents of a source expect target / source_size copies. In the order
    of size and id the prefix sum of these, shifted by the source's offset, is
    cut at the integers: a document is taken once for each integer that its step
    crosses. Order by size keeps the words taken near the target. Positions come
    from ranges over all rows, so a source with a third of them is no single task.
    Rows may repeat a doc_id or have none: each is placed and taken by itself. Sources of size 0 are not taken. An empty
    table gives an empty result; other columns are kept.
    """
    placed = with_global_index(rows, [F.asc_nulls_last("source"), "size", "doc_id"], "_idx")
    named = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    per = targets.select("*", F.coalesce(F.sum("docs").over(named), F.lit(0)).alias("_first"))
    per = per.withColumnRenamed("source", "_source")
    joined = placed.join(per, F.col("source").eqNullSafe(F.col("_source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("_idx") - F.col("_first")
    cut = lambda k: F.floor(offset(F.col("source"), seed) + ratio * k)
    return joined.withColumn("copies", cut(rank + 1) - cut(rank)).drop("_idx", "_first", "_source", "docs")


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Every document as often as the mix takes it, with its own columns.

    Each row is taken by itself, also where rows repeat a doc_id or have none. Null texts have size 0 and may be taken;
    a null source is a source. An empty table gives an empty mix. All columns are kept as they are, whatever their names.
    """
    keyed = keyed_rows(docs)
    rows = materialize(keyed.select("doc_id", F.col("_row.source").alias("source"), word_count("text").alias("size")), "sizes")
    targets = materialize(source_targets(rows), "targets")
    # copies of a source's rows differ by one at most; rows that are taken as often as most of their source stay where they are
    most = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    other = copies_per_document(rows, targets, seed).where(F.col("copies") != most).select("doc_id", F.col("copies").cast("int").alias("copies"))
    other = materialize(other, "copies")
    some, none = parted(keyed, other)
    taken = some.join(other, "doc_id", "left").select("_row", "copies").union(none.select("_row", F.lit(None).cast("int")))
    usual = F.broadcast(targets.select(F.col("source").alias("_source"), most.alias("_most")))  # one row for each source
    taken = taken.join(usual, F.col("_row.source").eqNullSafe(F.col("_source")))
    return taken.select("_row", F.explode(F.array_repeat(F.lit(1), F.coalesce("copies", "_most")))).select("_row.*")


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, beside its source's target."""
    docs = read(spark, sf_dir, "documents")
    rows = materialize(docs.select("doc_id", "source", word_count("text").alias("size")), "sizes")
    mixed = copies_per_document(rows, source_targets(rows))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_N = r"coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', chr(1), 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST({_N} AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
f AS (SELECT *, source_size * 1.0 / w AS lim,
  3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_w,
  coalesce(sum(docs) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_doc FROM w),
l AS (SELECT rest, open_w FROM f WHERE rest * w <= source_size * 4 * open_w ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST LIMIT 1),
t AS (SELECT f.source, f.source_size, f.first_doc, least(CAST(2 * f.source_size AS DOUBLE), coalesce(CAST(f.w * l.rest AS DOUBLE) / CAST(l.open_w * 2 AS DOUBLE), CAST(2 * f.source_size AS DOUBLE))) AS target
  FROM f LEFT JOIN l ON TRUE),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k,
  CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS ratio,
  CAST(('0x' || substr(md5('7:' || coalesce(d.source, '')), 1, 3)) AS BIGINT) / 4096.0 AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(CAST(off AS DOUBLE) + CAST(ratio AS DOUBLE) * k) - floor(CAST(off AS DOUBLE) + CAST(ratio AS DOUBLE) * (k - 1)) AS BIGINT) * size AS taken
FROM r
"""
