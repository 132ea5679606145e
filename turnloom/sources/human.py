"""Human evaluation below one folder: tasks, annotations, agreement, statistics, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What raters mark, and the range of marks; fixed values.
DIMENSIONS, LOWEST, HIGHEST = ["coherence", "goal_relevance", "fluency", "helpfulness", "naturalness", "overall"], 1.0, 5.0

_TASKS = "task_id string, dialogue_id string, assigned_to string, created_at timestamp"
_NOTES = "annotation_id string, task_id string, dialogue_id string, annotator_id string, dimensions map<string,double>, comments string, task_completed boolean, issues array<string>, annotated_at timestamp"


def invalid(dimensions) -> list[str]:
    """What is wrong with marks: names no rater knows and values out of range or missing."""
    bad = [f"unknown dimension {k}" for k in dimensions if k not in DIMENSIONS]
    return bad + [f"{k} out of range" for k, v in dimensions.items() if k in DIMENSIONS and not (v is not None and LOWEST <= v <= HIGHEST)]


class HumanEvaluation:
    """Tasks and annotations as append-only tables; every call adds files and rewrites none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json(f"{self.root}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def add_tasks(self, dialogues: DataFrame, assigned_to: str | None = None) -> None:
        """One task for each dialogue of the frame (``dialogue_id``), many at once."""
        made = dialogues.select(F.concat(F.lit("task_"), F.left(F.sha2(F.concat_ws("|", "dialogue_id", F.lit(assigned_to or "")), 256), F.lit(16))).alias("task_id"), "dialogue_id", F.lit(assigned_to).alias("assigned_to"), F.current_timestamp().alias("created_at"))
        made.write.mode("append").json(f"{self.root}/tasks")

    def tasks(self, assigned_to: str | None = None) -> DataFrame:
        """Tasks with ``done``, newest first, of one rater or all."""
        done = self.annotations().select("task_id").distinct().withColumn("done", F.lit(True))
        all_ = self._read("tasks", _TASKS).dropDuplicates(["task_id"]).join(done, "task_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
        return (all_.where(F.col("assigned_to") == assigned_to) if assigned_to else all_).orderBy(F.desc("created_at"), "task_id")

    def annotate(self, task_id: str, annotator_id: str, dimensions: dict[str, float], comments: str = "", task_completed: bool | None = None, issues: list[str] | None = None) -> None:
        """Add marks for a task; unknown tasks and invalid marks raise ``ValueError``."""
        if problems := invalid(dimensions):
            raise ValueError("; ".join(problems))
        task = self._read("tasks", _TASKS).where(F.col("task_id") == task_id).first()
        if task is None:
            raise ValueError(f"no task {task_id}")
        row = (f"{task_id}_{annotator_id}", task_id, task["dialogue_id"], annotator_id, {k: float(v) for k, v in dimensions.items()}, comments, task_completed, issues or [])
        self.spark.createDataFrame([row], _NOTES.rsplit(",", 1)[0]).withColumn("annotated_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self.root}/annotations")

    def annotations(self, dialogue_id: str | None = None, annotator_id: str | None = None) -> DataFrame:
        """Annotations, of one dialogue or one rater or both if named."""
        notes = self._read("annotations", _NOTES)
        for name, value in (("dialogue_id", dialogue_id), ("annotator_id", annotator_id)):
            notes = notes.where(F.col(name) == value) if value else notes
        return notes

    def _marks(self) -> DataFrame:
        return self.annotations().select("dialogue_id", "annotator_id", F.explode("dimensions").alias("dimension", "score")).where("score IS NOT NULL")

    def agreement(self, within: float = 1.0) -> DataFrame:
        """``dialogue_id, dimension, n, agreement, std`` where two or more marks exist: the share near their mean."""
        w = Window.partitionBy("dialogue_id", "dimension")
        m = self._marks().withColumn("m", F.avg("score").over(w)).withColumn("k", F.count("*").over(w)).where("k >= 2")
        return m.groupBy("dialogue_id", "dimension").agg(F.count("*").alias("n"), F.avg((F.abs(F.col("score") - F.col("m")) <= within).cast("double")).alias("agreement"), F.stddev_pop("score").alias("std"))

    def statistics(self) -> DataFrame:
        """``dimension, n, mean, std, min, max`` of all marks."""
        return self._marks().groupBy("dimension").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))

    def export(self, path: str) -> None:
        """Annotations and statistics as JSON."""
        self.annotations().write.mode("overwrite").json(f"{path}/annotations")
        self.statistics().write.mode("overwrite").json(f"{path}/statistics")
