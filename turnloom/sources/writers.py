"""Sinks and dataset versions: partitioned store, JSON lines, CSV, training bundle, stories, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import dialogues as D


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder in whatever file system holds it; False if it isn't there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_store(dialogues: DataFrame, root: str) -> None:
    """Write records partitioned by domain with their number of turns; domains not written stay.

    The domain goes through ``repartition`` with a salt from the id, so a hot
    domain is written by many tasks and a small one gives few files.
    """
    salted = dialogues.withColumn("metadata", F.col("metadata").withField("num_turns", F.size("turns"))).repartition(F.col("domain"), F.pmod(F.xxhash64("dialogue_id"), F.lit(16)))
    salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(root)


def upsert(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with the fresh records in place of those with the same id."""
    return store.join(fresh.select("dialogue_id"), "dialogue_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, one file per task."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_bundle(df: DataFrame, path: str) -> None:
    """A training bundle: ``train`` as JSON lines and ``info`` with counts per domain."""
    df.write.mode("overwrite").json(f"{path}/train")
    df.groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.size("turns")).alias("n_turns")).write.mode("overwrite").json(f"{path}/info")


def write_stories(df: DataFrame, path: str) -> None:
    """Training stories as text."""
    df.select(D.story(F.coalesce("dialogue_id", F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def write_object(spark: SparkSession, value: dict, path: str) -> None:
    """One small JSON object as a text file, times as ISO text."""
    import json

    text = json.dumps(value, ensure_ascii=False, indent=2, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def clear_domain(spark: SparkSession, root: str, domain: str) -> int:
    """Delete a domain of a store; gives the number of its records."""
    from turnloom.sources.readers import read_store

    n = read_store(spark, root, [domain]).count()
    remove(spark, f"{root}/domain={domain}")
    return n


def write_failures(dialogues: DataFrame, path: str) -> DataFrame:
    """A failure bundle of records: ``dialogues`` (JSON, a file name for each failed one), ``counts`` (CSV) and
    ``report`` (Markdown); gives the counts."""
    from turnloom.functions.text import slug
    from turnloom.operators.reports import failure_counts

    d = D.normal(dialogues)
    found = D.failures(d)
    counts = failure_counts(found)
    failed = d.select("rec_id", "dialogue_id", "goal", D.transcript().alias("transcript")).join(found.where(F.size("categories") > 0), "rec_id")
    failed.withColumn("file_name", slug(F.coalesce("dialogue_id", F.lit("")))).write.mode("overwrite").json(f"{path}/dialogues")
    write_csv(counts, f"{path}/counts")
    d.sparkSession.createDataFrame([(markdown(counts.orderBy("category")),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    return counts


def write_metrics(report: DataFrame, path: str) -> None:
    """A metric table as ``csv``, ``json`` and a Markdown ``text``."""
    write_csv(report, f"{path}/csv")
    report.write.mode("overwrite").json(f"{path}/json")
    report.sparkSession.createDataFrame([(markdown(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/text")


def write_corpus(corpus: DataFrame, path: str, goals_each: int = 100) -> None:
    """A processed corpus (``dialogue_id, domain, goal, turns``): ``dialogues``, ``seed_goals`` and ``stats``."""
    from turnloom.functions.text import clean
    from turnloom.operators.reports import seed_goals

    corpus.write.mode("overwrite").json(f"{path}/dialogues")
    goals = corpus.select(F.xxhash64("dialogue_id").alias("rec_id"), "domain", clean(F.col("goal")).alias("goal"))
    seed_goals(goals, goals_each).write.mode("overwrite").json(f"{path}/seed_goals")
    corpus.groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg(F.size("turns")), 6).alias("avg_turns")).write.mode("overwrite").json(f"{path}/stats")


def markdown(report: DataFrame, most: int = 200) -> str:
    """A small report as a Markdown table; at most ``most`` rows, which is the feature of a report."""
    rows = report.limit(most).collect()
    head = "| " + " | ".join(report.columns) + " |\n|" + "---|" * len(report.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)])


class Versions:
    """Snapshots of a corpus below one folder with a catalogue of their numbers and tags."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _catalogue(self) -> DataFrame:
        schema = "version_id string, parent string, description string, tags array<string>, n bigint, removed boolean, at timestamp"
        try:
            return self.spark.read.schema(schema).json(f"{self.root}/catalogue")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _note(self, version_id: str, parent: str | None = None, description: str | None = None, tags: list[str] | None = None, n: int | None = None, removed: bool = False) -> None:
        row = self.spark.createDataFrame([(version_id, parent, description, tags, n, removed)], "version_id string, parent string, description string, tags array<string>, n bigint, removed boolean")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self.root}/catalogue")

    def create(self, version_id: str, dialogues: DataFrame, description: str = "", parent: str | None = None, tags: list[str] | None = None) -> None:
        """Write a snapshot; the same id again replaces it."""
        dialogues.write.mode("overwrite").parquet(f"{self.root}/data/version_id={version_id}")
        self._note(version_id, parent, description, tags or [], self.load(version_id).count())

    def load(self, version_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/version_id={version_id}")

    def tag(self, version_id: str, tags: list[str]) -> None:
        self._note(version_id, tags=tags)

    def delete(self, version_id: str) -> None:
        """Take a snapshot out of the catalogue and delete its files."""
        self._note(version_id, removed=True)
        remove(self.spark, f"{self.root}/data/version_id={version_id}")

    def list(self, tags: list[str] | None = None) -> DataFrame:
        """``version_id, parent, description, tags, n, at`` of the living snapshots, newest first."""
        newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
        made = F.max(F.when(F.col("n").isNotNull(), F.col("at")))
        notes = self._catalogue()
        # a snapshot that was made again starts anew: its tags and its removal count from then on
        start = notes.groupBy("version_id").agg(made.alias("made"))
        since = notes.join(start, "version_id").where(F.col("made").isNotNull() & (F.col("at") >= F.col("made")))
        all_ = since.groupBy("version_id").agg(newest("parent"), newest("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), newest("n"), F.max("at").alias("at"), F.bool_or("removed").alias("removed"))
        live = all_.where(~F.col("removed")).drop("removed")
        return (live.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else live).orderBy(F.desc("version_id"))
