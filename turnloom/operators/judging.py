"""Judging dialogues: combined scores, decisions, closures, reports that merge, annotations and hubs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import stats as S
from turnloom.functions import text as X
from turnloom.operators import dialogues as D
from turnloom.operators.reports import first_rows

# Weights, limits and phrases that results depend on.
HEURISTIC_WEIGHT, COHERENCE_WEIGHT, OVERALL_WEIGHT = 0.3, 0.3, 0.4
HEURISTIC_LEAST, STRICT_LEAST, LENIENT_LEAST = 0.5, 3.0, 2.0
LOOP_SATISFIED = ["thank you", "thanks", "perfect", "great", "excellent", "that's great", "that works", "sounds good", "all set", "i'm all set", "that'll work", "appreciate it", "good, thank"]
LOOP_EVIDENCE = ["booked", "confirmed", "reserved", "reservation", "reference", "reference number", "pickup at", "at ", "pm", "am", "from ", "to ", "venue", "restaurant", "hotel", "taxi", "booking", "confirmation", "address", "phone number", "time is", "scheduled"]
SLOT_TIMES = ["morning", "evening", "tonight", "today", "tomorrow"]
CHECKS = {"length_ok": "length", "repetition_ok": "repetition", "language_ok": "profanity", "roles_ok": "roles", "goal_ok": "goal", "answers_ok": "answers"}
HUB_LEAST = 5


def combined_score(heuristic: Column, coherence: Column, overall: Column) -> Column:
    """Weighted score within 0..1 of the heuristic share and two marks out of five; absent marks count 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), HEURISTIC_WEIGHT * zero(heuristic) + COHERENCE_WEIGHT * zero(coherence) / 5 + OVERALL_WEIGHT * zero(overall) / 5))


def passes(heuristic: Column, coherence: Column, overall: Column, relevant: Column, failed: Column, strict: bool = True) -> Column:
    """True if the heuristics or the judge accept; where the judge ``failed`` the heuristics alone decide."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    least = STRICT_LEAST if strict else LENIENT_LEAST
    coherent, good, relevant = zero(coherence) >= least, zero(overall) >= least, F.coalesce(relevant, F.lit(False))
    judged = coherent & good & relevant if strict else (coherent & good) | (relevant & good)
    fine = zero(heuristic) >= HEURISTIC_LEAST
    return F.when(failed, fine).otherwise(fine | judged)


def assessed(checks: DataFrame, marks: DataFrame) -> DataFrame:
    """``rec_id, domain, overall, passed, issues`` of checked dialogues and the marks (``rec_id, coherence, overall,
    relevant``) that judges gave them; a dialogue without marks is one whose judge failed. ``issues`` names the checks
    that were not passed, in their fixed order."""
    both = checks.join(marks.withColumnRenamed("overall", "mark"), "rec_id", "left")
    args = [F.col(c) for c in ("heuristic", "coherence", "mark")]
    issues = F.array_join(F.filter(F.array(*[F.when(~F.col(c), name) for c, name in CHECKS.items()]), lambda x: x.isNotNull()), "; ")
    return both.select("rec_id", "domain", F.round(combined_score(*args), 6).alias("overall"), passes(*args, F.col("relevant"), F.col("mark").isNull()).alias("passed"), issues.alias("issues"))


def closing_evidence() -> Column:
    """True if in the last six turns, two at least, a user is satisfied and the support has shown a result."""
    last = F.slice("turns", F.greatest(F.size("turns") - 5, F.lit(1)), F.lit(6))
    says = lambda role, phrases: F.exists(last, lambda t: (t["role"] == role) & X.holds_any(F.lower(t["text"]), phrases))
    return (F.size("turns") >= 2) & says("User", LOOP_SATISFIED) & says("SupportBot", LOOP_EVIDENCE)


def near_complete(support: Column, user: Column) -> Column:
    """True if both progress notes say that the goal is near complete."""
    says = lambda c: F.coalesce(F.lower(c).contains("near") & F.lower(c).contains("complete"), F.lit(False))
    return says(support) & says(user)


def slot_tokens() -> Column:
    """Numbers and times of day that the goal names, repeated ones too."""
    return F.filter(F.split(F.lower("goal"), r"\s+"), lambda w: F.regexp_like(w, F.lit(r"^\d+$")) | w.isin(*SLOT_TIMES))


def partials(rows: DataFrame, metrics: list[str], by: list[Column]) -> DataFrame:
    """``metric, n, total, squares`` and the columns of ``by``: sums from which any merged report is computed."""
    long = rows.select(*by, *metrics).unpivot([c for c in rows.select(*by).columns], metrics, "metric", "x").where("x IS NOT NULL")
    return long.groupBy(*rows.select(*by).columns, "metric").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def merged_report(parts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """``metric, n, mean, std, low, high`` over all partials; equal to the report of all rows at once."""
    s = parts.groupBy("metric").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    mean = F.col("total") / F.col("n")
    std = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - F.col("total") * mean) / (F.col("n") - 1))).otherwise(0.0)
    half = S.z_of(confidence) * std / F.sqrt("n")
    return s.select("metric", "n", mean.alias("mean"), std.alias("std"), (mean - half).alias("low"), (mean + half).alias("high"))


def newest(rows: DataFrame, stamp: Column, most: int) -> DataFrame:
    """The last ``most`` rows by a textual time, oldest first within them by the caller's order; ties by id."""
    return rows.withColumn("_at", F.coalesce(stamp, F.lit(""))).orderBy(F.desc("_at"), F.desc("rec_id")).limit(most).drop("_at")


def lookup(store: DataFrame, domain: str, dialogue_id: str) -> DataFrame:
    """The stored record of an id within a domain, at most one; both filters reach the scan."""
    return store.where((F.col("domain") == domain) & (F.col("dialogue_id") == dialogue_id)).limit(1)


def few_shot_hub(rows: DataFrame, seeds: DataFrame, share: float) -> DataFrame:
    """``domain, dialogue_id, score, seeded``: the best ``share`` of all scored rows, and seeds for thin domains.

    A domain with fewer than HUB_LEAST examples gets up to HUB_LEAST of its
    seeds (``domain, dialogue_id``) in order.
    """
    best = first_rows(rows.where("score > 0").select("rec_id", "domain", "dialogue_id", "score"), [F.desc("score"), "rec_id"], lambda n: max(1, int(n * share)))
    best = best.select("domain", "dialogue_id", "score", F.lit(False).alias("seeded"))
    full = best.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n") >= HUB_LEAST)
    nth = F.row_number().over(Window.partitionBy("domain").orderBy("dialogue_id"))
    fill = seeds.join(F.broadcast(full), "domain", "left_anti").withColumn("nth", nth).where(F.col("nth") <= HUB_LEAST)  # one row per domain
    return best.unionByName(fill.select("domain", "dialogue_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("seeded")))


def examples(hub: DataFrame, each: int) -> DataFrame:
    """The first ``each`` examples of every domain by id."""
    nth = F.row_number().over(Window.partitionBy("domain").orderBy("seeded", "dialogue_id"))
    return hub.withColumn("nth", nth).where(F.col("nth") <= each)


def by_reference(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Rows (``ref_idx``) with the text of the reference of that number; unknown numbers get the first."""
    first = references.where("pos = 0").select("domain", F.col("goal").alias("first"))
    out = rows.join(references.select("domain", F.col("pos").alias("ref_idx"), "goal"), ["domain", "ref_idx"], "left").join(first, "domain", "left")
    return out.withColumn("reference", F.coalesce("goal", "first")).drop("goal", "first")


def arms_by_seed(arms: list[str], seeds: DataFrame) -> DataFrame:
    """Every seed under every arm of an experiment: a fixed list of arms in each row, not a join."""
    return seeds.select(F.explode(F.array(*map(F.lit, arms))).alias("arm"), *seeds.columns)


def vertical(domain: Column) -> Column:
    """The field a domain belongs to: healthcare, education, customer_support, booking or general."""
    name = F.regexp_replace(F.lower(D.strip(F.coalesce(domain, F.lit("")))), "[ -]", "_")
    out = None
    for field, names in VERTICALS.items():
        out = F.when(name.isin(*names), field) if out is None else out.when(name.isin(*names), field)
    return out.otherwise("general")


# The names of the fields.
VERTICALS = {
    "healthcare": ["healthcare", "health", "medical", "clinical", "clinic", "pharmacy", "patient", "telehealth"],
    "education": ["education", "edtech", "tutoring", "tutor", "course", "school", "university", "learning", "student"],
    "customer_support": ["technical_support", "tech_support", "it_support", "customer_support", "support", "helpdesk", "billing_support"],
    "booking": ["hotel", "restaurant", "taxi", "train", "attraction", "booking", "flight", "car_rental", "event"],
}


def distinct_over(rows: DataFrame, extract) -> DataFrame:
    """The rows with ``distinct_1`` of the text that ``extract()`` gives: any column expression over a record."""
    return rows.withColumn("distinct_1", X.once(X.words(extract()), X.distinct_share))


def scorer(f):
    """A column function out of a Python function on two texts, run over Arrow batches; for scorers of the user's own.

    The function is sent to the workers once; a text that is null is given as an empty one.
    """
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b)], dtype=float)

    return score


def judge_prompt(last: int) -> Column:
    """What a judge is asked about a dialogue: its goal and its last turns."""
    tail = F.slice("turns", F.greatest(F.size("turns") - last + 1, F.lit(1)), F.lit(last))
    said = F.array_join(F.transform(tail, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return F.concat(F.lit("Goal: "), F.col("goal"), F.lit("\nConversation:\n"), said, F.lit("\nScore from 1 to 5:"))
