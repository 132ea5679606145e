"""What a server over the corpus would call, as plain methods; no web framework is involved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import dialogues as D
from turnloom.operators import judging as J
from turnloom.operators import reports
from turnloom.sources import readers, writers
from turnloom.sources.human import HumanEvaluation

#: Metrics of an evaluation; fixed names.
METRICS = ["distinct_1", "coherence", "n_turns", "completed", "satisfied", "heuristic"]


class Service:
    """Evaluation, versions and human ratings of a corpus below one folder."""

    def __init__(self, spark: SparkSession, root: str, progress=None):
        """``progress(step, state)`` is called when a step begins and ends; it may be anything callable."""
        self.spark, self.root, self.progress = spark, root, progress or (lambda step, state: None)
        self.versions, self.human = writers.Versions(spark, f"{root}/versions"), HumanEvaluation(spark, f"{root}/human")

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def schema(self) -> str:
        """The stored form of a dialogue."""
        return readers.SCHEMA

    def evaluate(self, dialogues: DataFrame, extract=D.whole, latest: int | None = None) -> DataFrame:
        """``metric, n, mean, std, low, high`` of records; ``extract`` gives the text that diversity is measured on.

        ``latest`` takes the newest records only, which is what a caller asks for, not a cap.
        """
        self.progress("evaluate", "begins")
        rows = dialogues if latest is None else J.newest(dialogues, F.col("metadata.generated_at"), latest)
        d = D.normal(rows)
        checks = D.checks(d).select("rec_id", "heuristic")
        measured = d.select("rec_id", X.once(X.words(extract()), X.distinct_share).alias("distinct_1"), D.coherence().alias("coherence"), F.size("turns").cast("double").alias("n_turns"), D.goal_completion().cast("double").alias("completed"), D.satisfied().cast("double").alias("satisfied"))
        out = J.merged_report(J.partials(measured.join(checks, "rec_id"), METRICS, []))
        self.progress("evaluate", "ends")
        return out

    def failures(self, dialogues: DataFrame, path: str | None = None) -> DataFrame:
        """Failure counts, and the bundle below ``path`` if one is named."""
        return writers.write_failures(dialogues, path) if path else reports.failure_counts(D.failures(D.normal(dialogues)))

    def compare(self, old: str, new: str) -> DataFrame:
        """Differences between two versions."""
        both = self.versions.load(old).withColumn("version_id", F.lit("a")).unionByName(self.versions.load(new).withColumn("version_id", F.lit("b")), allowMissingColumns=True)
        out = reports.compare_first_and_last(D.normal(both))
        return out.withColumn("old_version", F.lit(old)).withColumn("new_version", F.lit(new))

    def export(self, version_id: str, kind: str, path: str) -> None:
        """A version as ``lines``, ``bundle`` or ``stories``; other kinds raise ``ValueError``."""
        d = self.versions.load(version_id)
        writing = {"lines": lambda: writers.write_lines(d, path), "bundle": lambda: writers.write_bundle(d, path), "stories": lambda: writers.write_stories(D.normal(d), path)}
        if kind not in writing:
            raise ValueError(f"unknown kind of export: {kind}")
        writing[kind]()

    def records(self, version_id: str, most: int) -> DataFrame:
        """The first ``most`` records of a version by id."""
        return self.versions.load(version_id).orderBy("rec_id").limit(most)
