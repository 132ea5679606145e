"""Reports over dialogue records: counts, versions, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators import dialogues as D
from turnloom.sources.tables import keep


def failure_counts(failures: DataFrame) -> DataFrame:
    """``category, n, share, share_of_failed``: every category, those without cases too; one pass."""
    each = [F.count_if(F.array_contains("categories", c)).alias(c) for c in D.CATEGORIES]
    one = failures.agg(F.count("*").alias("total"), F.count_if(F.size("categories") > 0).alias("failed"), *each)
    share = lambda by: F.round(F.coalesce(F.try_divide("n", by), F.lit(0.0)), 6)
    return one.unpivot(["total", "failed"], D.CATEGORIES, "category", "n").select("category", "n", share("total").alias("share"), share("failed").alias("share_of_failed"))


def version_statistics(d: DataFrame) -> DataFrame:
    """``version_id, n, avg_turns, n_domains, checksum`` of each snapshot; the checksum is a sum of
    row hashes, free of order and combined before the shuffle."""
    row = F.md5(F.concat_ws("|", F.col("rec_id").cast("string"), F.coalesce("dialogue_id", F.lit("")), "goal"))
    part = F.conv(F.left(row, F.lit(12)), 16, 10).cast("decimal(38,0)")
    return d.groupBy("version_id").agg(
        F.count("*").alias("n"), F.round(F.avg(F.size("turns")), 6).alias("avg_turns"), F.countDistinct("domain").alias("n_domains"),
        (F.sum(part) % 1_000_000_000_000).cast("decimal(20,0)").cast("string").alias("checksum"),
    )


def compare_first_and_last(d: DataFrame) -> DataFrame:
    """Differences between the first and the last snapshot; two rows of aggregates are compared."""
    v = d.groupBy("version_id").agg(F.count("*").alias("n"), F.avg(F.size("turns")).alias("t"), F.avg("score").alias("s"))
    edge = v.agg(F.min_by(F.struct("version_id", "n", "t", "s"), "version_id").alias("a"), F.max_by(F.struct("version_id", "n", "t", "s"), "version_id").alias("b")).where("a IS NOT NULL")
    return edge.select(F.col("a.version_id").alias("old_version"), F.col("b.version_id").alias("new_version"), (F.col("b.n") - F.col("a.n")).alias("d_count"), F.round(F.col("b.t") - F.col("a.t"), 6).alias("d_turns"), F.round(F.col("b.s") - F.col("a.s"), 6).alias("d_score"))


def seed_goals(goals: DataFrame, most: int) -> DataFrame:
    """``domain, goal, k``: the first ``most`` distinct goals of each domain in order of their first record."""
    first = goals.where("goal <> ''").groupBy("domain", "goal").agg(F.min("rec_id").alias("first"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("first", "goal"))).where(F.col("k") <= most).select("domain", "goal", "k")


def first_rows(rows: DataFrame, order: list, wanted) -> DataFrame:
    """The first ``wanted(total)`` rows in the given total order, however many those are.

    Rows are sorted by ranges and kept; one count per partition then tells in
    which one the last wanted row lies. No task holds more than its range, and
    a run of ties is parted by the columns behind it in the order.
    """
    at = F.monotonically_increasing_id()
    placed = keep(rows.sort(*order)).withColumn("_part", F.shiftright(at, 33)).withColumn("_nth", at.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    left, last = wanted(sum(counts.values())), -1
    for part in sorted(counts):
        last = part
        if counts[part] >= left:
            break
        left -= counts[part]
    return placed.where((F.col("_part") < last) | ((F.col("_part") == last) & (F.col("_nth") < left))).drop("_part", "_nth")


def best_share(rows: DataFrame, share: float) -> DataFrame:
    """The best ``share`` of the rows by score, at least one; ties by id."""
    return first_rows(rows, [F.desc("score"), "rec_id"], lambda n: max(1, int(n * share)))


def discard(rows: DataFrame, accepted: Column, target: float) -> DataFrame:
    """``rec_id`` of accepted rows to drop, the lowest first, until ``target`` of all rows is rejected."""
    n = rows.agg(F.count("*").alias("total"), F.count_if(F.coalesce(accepted, F.lit(False))).alias("acc")).first()
    gone = (n["total"] - n["acc"]) / n["total"] if n["total"] else target
    return first_rows(rows.where(accepted).select("score", "rec_id"), ["score", "rec_id"], lambda acc: int(acc * max(0.0, target - gone))).select("rec_id")


def sound_lines(records: DataFrame) -> DataFrame:
    """``feed, n_lines, n_sound, n_files``: JSON lines that hold an object."""
    sound = F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False))
    return records.groupBy("feed").agg(F.count("*").alias("n_lines"), F.count_if(sound).alias("n_sound"), F.countDistinct("file_name").alias("n_files"))


def map_changes(old: Column, new: Column) -> Column:
    """Keys whose values differ between two maps, with both values; nulls count as values."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(old, k).alias("old"), F.try_element_at(new, k).alias("new"))), lambda x: ~x["old"].eqNullSafe(x["new"]))
