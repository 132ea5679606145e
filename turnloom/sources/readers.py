"""Readers of dialogue corpora: single objects, arrays, lines, wrapped arrays, Parquet, partitioned stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stored form of a dialogue.
SCHEMA = (
    "dialogue_id string, goal string, domain string, context string, user_persona string, "
    "turns array<struct<role:string,text:string,timestamp:string>>, "
    "metadata struct<num_turns:int,quality_score:double,generated_at:string,model_version:string>, _corrupt string"
)


def read_json(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of JSON files that hold one object or one array each; unreadable files give no rows."""
    inner = schema.replace(", _corrupt string", "")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.from_json("value", f"array<struct<{_as_struct(inner)}>>").alias("r")).select(F.inline("r"))


def read_lines(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of JSON lines; blank and broken lines are left out."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return parsed.where(F.col("_corrupt").isNull()).drop("_corrupt") if "_corrupt" in parsed.columns else parsed


def read_wrapped(spark: SparkSession, path: str, field: str = "dialogues", schema: str = SCHEMA) -> DataFrame:
    """Records of JSON files that hold an object with an array of records."""
    inner = schema.replace(", _corrupt string", "")
    return spark.read.schema(f"{field} array<struct<{_as_struct(inner)}>>").option("multiLine", True).json(path).select(F.inline(field))


def _as_struct(ddl: str) -> str:
    """Top-level ``name type`` pairs as ``name:type``."""
    out, depth = [], 0
    for part in ddl.split(","):
        fresh = depth == 0
        depth += part.count("<") - part.count(">")
        out.append(part.strip().replace(" ", ":", 1) if fresh else part)
    return ",".join(out)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus by its suffix: ``.jsonl``, ``.parquet``, or ``.json`` with objects or arrays."""
    if path.endswith(".jsonl"):
        return read_lines(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".json"):
        return read_json(spark, path)
    raise ValueError(f"unknown kind of corpus: {path}")


def read_store(spark: SparkSession, root: str, domains: list[str] | None = None, least_score: float | None = None) -> DataFrame:
    """A store partitioned by domain; domain and score filters are pushed to the scan."""
    df = spark.read.parquet(root)
    if domains is not None:
        df = df.where(F.col("domain").isin(domains))
    if least_score is not None:
        df = df.where(F.coalesce(F.col("metadata.quality_score"), F.lit(0.0)) >= least_score)
    return df


_FRAMES = "array<struct<service:string,state:struct<active_intent:string,slot_values:map<string,array<string>>>>>"


def read_reference_corpus(spark: SparkSession, path: str, splits: list[str] | None = None, most: int | None = None) -> DataFrame:
    """``dialogue_id, domain, goal, turns`` of a corpus in speaker/utterance form; dialogues without turns are dropped.

    ``splits`` are sub-folders to read (all of ``path`` if none are named),
    ``most`` a limit on the dialogues by id, which is a feature of the reader.
    The domain is the first service whose frames hold slot values, else the
    first service, else ``unknown``; the goal is ``slot: value; ...`` of the
    first filled frame of that service, or a sentence naming the domain.
    """
    schema = f"dialogue_id string, services array<string>, turns array<struct<speaker:string,utterance:string,turn_id:string,frames:{_FRAMES}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json([f"{path}/{s}/*.json" for s in splits] if splits else path)
    out = normalised(raw)
    return out.orderBy("dialogue_id").limit(most) if most is not None else out


def normalised(raw: DataFrame) -> DataFrame:
    """The reference form of raw speaker/utterance dialogues; see ``read_reference_corpus``."""
    turns = F.transform(F.filter("turns", lambda t: F.coalesce(t["utterance"], F.lit("")) != ""), lambda t: F.struct(F.when(t["speaker"] == "USER", "User").otherwise("SupportBot").alias("role"), t["utterance"].alias("text")))
    frames = F.filter(F.flatten(F.transform("turns", lambda t: F.coalesce(t["frames"], F.array()))), lambda f: F.coalesce(F.size(f["state"]["slot_values"]), F.lit(0)) > 0)
    base = raw.select("dialogue_id", "services", turns.alias("turns"), frames.alias("frames")).where(F.size("turns") > 0)
    filled = F.filter("services", lambda s: F.exists("frames", lambda f: f["service"] == s))
    domain = F.coalesce(F.get(filled, F.lit(0)), F.get("services", F.lit(0)), F.lit("unknown"))
    base = base.withColumn("domain", domain)
    slots = F.get(F.filter("frames", lambda f: f["service"] == F.col("domain")), F.lit(0))["state"]["slot_values"]
    said = F.transform(F.array_sort(F.map_keys(slots)), lambda k: F.concat(k, F.lit(": "), F.coalesce(F.get(F.try_element_at(slots, k), F.lit(0)), F.lit(""))))
    goal = F.when(F.size(said) > 0, F.array_join(said, "; ")).otherwise(F.concat(F.lit("Get help with "), F.col("domain")))
    return base.select("dialogue_id", "domain", goal.alias("goal"), "turns")


def read_uploads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of several uploaded files, each an object, an array or ``{"dialogues": [...]}``, one after another."""
    inner = _as_struct(SCHEMA.replace(", _corrupt string", ""))
    whole = spark.read.text(paths, wholetext=True)
    plain, wrapped = F.from_json("value", f"array<struct<{inner}>>"), F.from_json("value", f"dialogues array<struct<{inner}>>")["dialogues"]
    return whole.select(F.inline(F.coalesce(wrapped, plain)))


def upload_problem(records: DataFrame, most: int = 500) -> str | None:
    """What is wrong with uploaded records: none at all, more than ``most``, or the first that lacks a field."""
    n = records.limit(most + 1).count()
    if n == 0 or n > most:
        return "no dialogues" if n == 0 else f"more than {most} dialogues"
    fine = F.col("dialogue_id").isNotNull() & F.col("goal").isNotNull() & F.col("domain").isNotNull() & (F.size("turns") > 0)
    at = F.monotonically_increasing_id()
    first = records.withColumn("_k", at).where(~F.coalesce(fine, F.lit(False))).agg(F.min("_k")).first()[0]
    return None if first is None else f"dialogue {first} lacks an id, a goal, a domain or turns"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metric table written as CSV with a header; numbers are read as numbers."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
