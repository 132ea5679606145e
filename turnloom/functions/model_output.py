"""Structured values out of the noisy texts that models return, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.text import json_object
from turnloom.sources.tables import strip

# The fields of a plan, limits of lists, severities in order.
PLAN_LISTS = ["subgoals", "missing_information"]
PLAN_TEXTS = ["goal_progress", "next_action", "dialogue_state", "reasoning"]
FACTS, MILESTONES, CONTRADICTIONS, SUMMARY = 10, 12, 8, 4000
SEVERITIES = ["low", "medium", "high"]


def _field(obj: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(obj, f"$.{name}", kind)


def _texts(obj: Column, name: str, most: int) -> Column:
    """A list of non-blank texts; anything else is an empty list."""
    items = F.coalesce(_field(obj, name, "array<string>"), F.array().cast("array<string>"))
    return F.slice(F.filter(F.transform(items, lambda s: strip(s)), lambda s: F.coalesce(s, F.lit("")) != ""), 1, most)


def plan(text: Column) -> Column:
    """A plan with all its fields: lists without blanks, texts trimmed, absent ones empty; null without an object."""
    obj = json_object(text)
    parts = [_texts(obj, n, 100).alias(n) for n in PLAN_LISTS] + [strip(F.coalesce(_field(obj, n, "string"), F.lit(""))).alias(n) for n in PLAN_TEXTS]
    return F.when(obj.isNotNull(), F.struct(*parts))


def plan_issues(text: Column) -> Column:
    """What is wrong with a plan: ``no_object``, ``missing_x``, ``not_a_list_x`` or ``not_a_text_x``."""
    obj = json_object(text)
    raw = lambda n: F.try_variant_get(obj, f"$.{n}", "variant")
    tests = [F.when(obj.isNull(), "no_object")]
    for n in PLAN_LISTS + PLAN_TEXTS:
        is_list, kind = n in PLAN_LISTS, F.schema_of_variant(raw(n))
        fine = kind.startswith("ARRAY") if is_list else kind == "STRING"
        tests.append(F.when(obj.isNotNull() & raw(n).isNull(), f"missing_{n}").when(obj.isNotNull() & ~fine, f"not_a_{'list' if is_list else 'text'}_{n}"))
    return F.filter(F.array(*tests), lambda t: t.isNotNull())


def verdict(text: Column, least: float = 4.0) -> Column:
    """``score`` clipped to 0..5, ``issues`` and ``accepted`` (score at least ``least``, and no issue unless it is 5)."""
    obj = json_object(text)
    score = F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.coalesce(_field(obj, "score", "double"), F.lit(0.0))))
    issues = _texts(obj, "issues", 100)
    return F.when(obj.isNotNull(), F.struct(score.alias("score"), issues.alias("issues"), ((score >= least) & ((F.size(issues) == 0) | (score >= 5))).alias("accepted")))


def facts(text: Column) -> Column:
    """``user_facts`` and ``support_facts``, at most ten each; empty lists without an object."""
    obj = json_object(text)
    return F.struct(_texts(obj, "user_facts", FACTS).alias("user_facts"), _texts(obj, "support_facts", FACTS).alias("support_facts"))


def milestones(text: Column) -> Column:
    """At most twelve milestones."""
    return _texts(json_object(text), "milestones", MILESTONES)


def summary(text: Column, prior: Column) -> Column:
    """The summary, at most 4,000 characters, or the one before."""
    found = strip(_field(json_object(text), "summary", "string"))
    return F.when(F.coalesce(found, F.lit("")) != "", F.left(found, F.lit(SUMMARY))).otherwise(prior)


def contradictions(text: Column) -> Column:
    """At most eight contradictions as (text, severity); unknown severities count as ``medium``."""
    items = F.coalesce(F.try_variant_get(json_object(text), "$.contradictions", "array<struct<text:string,severity:string>>"), F.array().cast("array<struct<text:string,severity:string>>"))
    known = lambda s: F.when(F.lower(s).isin(SEVERITIES), F.lower(s)).otherwise("medium")
    return F.slice(F.transform(F.filter(items, lambda c: F.coalesce(strip(c["text"]), F.lit("")) != ""), lambda c: F.struct(strip(c["text"]).alias("text"), known(c["severity"]).alias("severity"))), 1, CONTRADICTIONS)


def worst(items: Column) -> Column:
    """The highest severity of a list of contradictions, ``none`` if it is empty."""
    rank = F.array_max(F.transform(items, lambda c: F.array_position(F.array(*map(F.lit, SEVERITIES)), c["severity"])))
    return F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), (rank - 1).cast("int")), F.lit("none"))


def spoken(text: Column) -> Column:
    """A reply without speaker labels and surrounding quotes."""
    bare = F.regexp_replace(strip(text), r"(?i)^(?:\s*(?:user|supportbot|support bot|support|assistant|bot|agent|customer|system)\s*:\s*)+", "")
    return F.regexp_replace(bare, r"^[\"'“”]+|[\"'“”]+$", "")


def plan_and_reply(text: Column) -> Column:
    """``plan`` and ``reply`` of a text in two labelled parts; without labels all is reply."""
    said = F.regexp_extract(text, r"(?is)REPLY\s*:\s*(.*)$", 1)
    return F.struct(F.nullif(strip(F.regexp_extract(text, r"(?is)PLAN\s*:\s*(.*?)(?=REPLY\s*:|$)", 1)), F.lit("")).alias("plan"), spoken(F.when(strip(said) != "", said).otherwise(text)).alias("reply"))


def turns_of(text: Column) -> Column:
    """Turns out of lines ``User: ...`` and ``SupportBot: ...``; null for fewer than two."""
    lines = F.filter(F.split(text, r"\n"), lambda s: F.regexp_like(s, F.lit(r"(?i)^\s*(user|supportbot)\s*:\s*\S")))
    turns = F.transform(lines, lambda s: F.struct(F.when(F.lower(strip(s)).startswith("user"), "User").otherwise("SupportBot").alias("role"), strip(F.regexp_replace(s, r"^[^:]*:", "")).alias("text")))
    spoken_ = F.filter(turns, lambda t: t["text"] != "")
    return F.when(F.size(spoken_) >= 2, spoken_)
