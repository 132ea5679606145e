"""A score cutoff per source that keeps a wanted share of its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.sources.tables import bounded, keep, strip

#: Cells in which one narrowing step counts; two steps part scores that differ by 2**-32.
CELLS = 65_536


def source_of(domain: Column) -> Column:
    """Trimmed, lower-case source name; null and blank give ``unknown``."""
    name = F.lower(strip(domain))
    return F.when(name.isNull() | (name == ""), "unknown").otherwise(name)


def valid_score(score: Column) -> Column:
    """The score as double, or null if it is null, NaN or outside 0..1."""
    s = score.cast("double")
    return F.when(~F.isnan(s) & s.between(0.0, 1.0), s)


def cutoffs(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, keep_percent, n_scored, cutoff, n_kept`` for each source with a target.

    ``rows`` has ``source`` and ``score`` (null where there is none); ``targets``
    has ``source`` and ``keep_percent``. The cutoff is the highest occurring
    score c for which the rows with score >= c are at least the wanted percent.

    Rows are first counted by (source, score) with map-side combination, so a
    source holding a third of all rows costs no task more than another. The
    exact cumulative position is then found in two counting steps, each over at
    most ``CELLS`` cells per source; only the distinct scores inside one cell of
    the second step are sorted. Ties fall together into one (source, score)
    count. Empty input gives no rows; of repeated targets the largest counts.
    """
    hist = keep(rows.where(F.col("score").isNotNull()).groupBy("source", "score").agg(F.count("*").alias("n")))
    goals = targets.where(F.col("source").isNotNull() & F.col("keep_percent").isNotNull()).groupBy("source").agg(F.max("keep_percent").alias("keep_percent"))
    need = F.ceil(F.col("n_scored") * F.col("keep_percent") / 100.0)
    totals = hist.groupBy("source").agg(F.sum("n").alias("n_scored")).join(F.broadcast(goals), "source")
    # one row per source: the cell that holds the wanted position, and the rows above it
    at = keep(totals.select("source", "keep_percent", "n_scored", need.alias("need"), F.lit(0).cast("long").alias("above"), F.lit(0.0).alias("low"), F.lit(1.0).alias("width")))
    down = lambda c: Window.partitionBy("source").orderBy(F.desc(c)).rowsBetween(Window.unboundedPreceding, 0)
    cell = F.least(F.floor((F.col("score") - F.col("low")) / F.col("width") * CELLS), F.lit(CELLS - 1)).cast("int")
    inside = F.col("score").between(F.col("low"), F.col("low") + F.col("width"))
    for _ in range(2):
        cells = hist.join(bounded(at), "source").where(inside & (cell >= 0)).groupBy(*at.columns, cell.alias("cell")).agg(F.sum("n").alias("m"))
        cum = cells.withColumn("upto", F.col("above") + F.sum("m").over(down("cell")))
        hit = cum.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("m") < F.col("need")))
        at = keep(hit.select("source", "keep_percent", "n_scored", "need", (F.col("upto") - F.col("m")).alias("above"), (F.col("low") + F.col("cell") * F.col("width") / CELLS).alias("low"), (F.col("width") / CELLS).alias("width")))
    # a score on an edge may have been counted in the next cell, so the last step looks a little beyond the cell and counts what lies above by itself
    edge = F.col("width") * 1e-3
    near = hist.join(bounded(at), "source").where(F.col("score").between(F.col("low") - edge, F.col("low") + F.col("width") + edge))
    top = near.groupBy("source").agg(F.max("score").alias("top"))
    over = hist.join(bounded(keep(top)), "source").groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("score") > F.col("top"), F.col("n"))), F.lit(0)).alias("over"))
    last = near.join(bounded(keep(over)), "source").withColumn("n_kept", F.col("over") + F.sum("n").over(down("score"))).where(F.col("n_kept") >= F.col("need"))
    return last.groupBy("source", "keep_percent", "n_scored").agg(F.max("score").alias("cutoff"), F.min("n_kept").alias("n_kept"))


def kept(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows whose score reaches the cutoff of their source.

    A row without score or without a target for its source is not kept. There
    is one cutoff row per source, so the join multiplies nothing.
    """
    return rows.join(cuts.select("source", "cutoff"), "source").where(F.col("score") >= F.col("cutoff"))
