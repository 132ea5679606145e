"""The memory of a dialogue: facts and slots merged over its turns, newer values first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Facts a memory keeps, the first ones; fixed value.
FACTS = 12

_SLOTS = "map<string,map<string,string>>"


def unique_head(items: Column, most: int = FACTS) -> Column:
    """Distinct non-blank items in order of their first occurrence, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != ""))), 1, most)


def merged(old: Column, new: Column) -> Column:
    """Two maps of maps as one; where both hold a slot, the newer value that is not null."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(old, new, lambda _, a, b: F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _k, x, y: F.coalesce(y, x)))


def fold(dialogues: DataFrame) -> DataFrame:
    """``rec_id, user_facts, support_facts, n_slots, slots``: the memory after the last pipeline turn.

    A fold inside the row; null snapshots change nothing. Records without
    pipeline turns give no row. ``slots`` is JSON with its keys in order.
    """
    snaps = F.filter(F.transform("pipeline_turns", lambda p: p["memory_snapshot"]), lambda m: m.isNotNull())
    facts = lambda name: unique_head(F.flatten(F.transform(snaps, lambda m: F.coalesce(m[name], F.array().cast("array<string>")))))
    slots = F.aggregate(snaps, F.create_map().cast(_SLOTS), lambda acc, m: merged(acc, F.coalesce(m["slots"], F.create_map().cast(_SLOTS))))
    flat = F.array_sort(F.flatten(F.transform(F.map_entries(slots), lambda e: F.transform(F.map_entries(e["value"]), lambda s: F.struct(e["key"].alias("domain"), s["key"].alias("slot"), s["value"].alias("value"))))))
    return dialogues.where(F.size("pipeline_turns") > 0).select("rec_id", facts("user_facts").alias("user_facts"), facts("support_facts").alias("support_facts"), F.size(flat).alias("n_slots"), F.to_json(flat).alias("slots"))


def conflicts(dialogues: DataFrame) -> DataFrame:
    """``rec_id, pos, domain, slot, old, new``: every slot that a snapshot gives another value than the last one had.

    ``pos`` is the position in ``pipeline_turns``. Values that are null change
    nothing, in either snapshot; slots of a null domain are left out.
    """
    def one(p: Column, i: Column) -> Column:
        inner = lambda k, m: F.transform(F.map_entries(m), lambda s: F.struct(k.alias("domain"), s["key"].alias("slot"), i.alias("pos"), s["value"].alias("value")))
        return F.flatten(F.filter(F.transform(F.map_entries(p["memory_snapshot"]["slots"]), lambda e: inner(e["key"], e["value"])), lambda x: x.isNotNull()))

    given = F.flatten(F.filter(F.transform("pipeline_turns", one), lambda x: x.isNotNull()))
    ordered = F.array_sort(F.filter(given, lambda s: s["value"].isNotNull()))
    rows = dialogues.select("rec_id", ordered.alias("s")).where(F.size("s") > 1)
    n = F.size("s") - 1
    pairs = F.zip_with(F.slice("s", F.lit(1), n), F.slice("s", F.lit(2), n), lambda a, b: F.struct((a["domain"] == b["domain"]).alias("d"), (a["slot"] == b["slot"]).alias("k"), b["pos"].alias("pos"), b["domain"].alias("domain"), b["slot"].alias("slot"), a["value"].alias("old"), b["value"].alias("new")))
    changed = F.filter(pairs, lambda p: p["d"] & p["k"] & (p["old"] != p["new"]))
    return rows.select("rec_id", F.inline(changed)).drop("d", "k")


def section(facts: Column, others: Column, goals: Column) -> Column:
    """A memory as the section of a prompt: one line for each kind that holds something, lists joined by semicolons."""
    line = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(f"{name}: "), F.array_join(items, "; ")))
    return F.concat_ws("\n", line("User facts", facts), line("Support facts", others), line("Open goals", goals))


def stored(facts: Column, others: Column, goals: Column) -> Column:
    """A memory as JSON text with its lists cut to FACTS, and ``read`` gives it back."""
    return F.to_json(F.struct(unique_head(facts).alias("user_facts"), unique_head(others).alias("support_facts"), unique_head(goals).alias("unresolved_goals")))


def read(text: Column) -> Column:
    """The lists of a stored memory; absent or broken ones are empty."""
    m = F.from_json(text, "user_facts array<string>, support_facts array<string>, unresolved_goals array<string>")
    full = lambda name: F.coalesce(m[name], F.array().cast("array<string>")).alias(name)
    return F.struct(full("user_facts"), full("support_facts"), full("unresolved_goals"))


def new_metadata(n_turns: Column, score: Column, seconds: Column, version: Column, at: Column) -> Column:
    """The metadata of a fresh record; absent scores and times count 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(F.coalesce(n_turns, F.lit(0)).alias("num_turns"), zero(score).alias("quality_score"), zero(seconds).alias("generation_time_seconds"), F.coalesce(version, F.lit("unknown")).alias("model_version"), at.alias("generated_at"))
