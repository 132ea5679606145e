"""Deeply nested dialogue records as flat tables with Merkle identities.

Every object of a record, from the record down to its plans, facts and
assessment, is canonicalised from its own fields and the identities of its
children, and hashed bottom-up. Equal objects are stored once; every occurrence
is a bridge row with its record, position and ordinal and the identity of its
parent. One scan builds all bridge rows of a record inside the row itself, so
nothing is shuffled until objects are made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import once
from turnloom.sources.tables import strip

#: The kinds of objects, from the record downwards; the last four are the child tables.
KINDS = ["record", "turn", "pipeline_turn", "memory_snapshot", "metadata", "plan", "user_fact", "assessment", "assessment_broken"]
CHILDREN = ["plan", "user_fact", "assessment", "assessment_broken"]


def text_part(value: Column) -> Column:
    """A value in canonical text: its length and itself, or ``~`` for null, so that no two lists of values agree."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("~"))


def id_part(value: Column) -> Column:
    """An identity as it is, since all are of one length, or ``~`` for null."""
    return F.coalesce(value, F.lit("~"))


def number_part(value: Column) -> Column:
    """A fraction with nine decimals; NaN and null have texts of their own."""
    return once(F.when(F.isnan(value), F.lit("nan")).otherwise(value.cast("decimal(38,9)").cast("string")), text_part)


def list_part(values: Column, part=text_part) -> Column:
    """A list in order; null is ``~``."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(values, part), ""), F.lit("]")), F.lit("~"))


def map_part(values: Column, part=text_part) -> Column:
    """A map in order of its keys; null is ``~``."""
    keys = F.array_sort(F.map_keys(values))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(text_part(k), part(F.try_element_at(values, k)))), ""), F.lit("}")), F.lit("~"))


def canonical(kind: str, *parts: Column) -> Column:
    """The canonical text of an object: its kind and the parts of its fields in their fixed order."""
    return F.concat(F.lit(kind + "|"), *parts)


def node(text: Column) -> Column:
    """Identity of a subtree: the hash of its canonical text, which holds the identities of its children."""
    return F.sha2(text, 256)


def _row(child, pos, item, made: Column, parent: Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(child).alias("child"), as_col(pos).cast("int").alias("pos"), as_col(item).cast("int").alias("item"), made["id"].alias("node_id"), parent.alias("parent_id"), made["body"].alias("body"))


def _made(body: Column, **more: Column) -> Column:
    """``body, id`` and what else belongs to an object; null where the body is. The body is computed once."""
    return once(body, lambda b: F.when(b.isNotNull(), F.struct(b.alias("body"), node(b).alias("id"), *[c.alias(n) for n, c in more.items()])))


def _leaf(kind: str, value: Column) -> Column:
    """A plan or fact without outer white space; null where it is blank."""
    return _made(once(strip(value), lambda s: F.when(s != "", canonical(kind, text_part(s)))))


def _turns() -> Column:
    """Every turn in order, with its ``plan``; null turns stay null."""
    def one(t: Column) -> Column:
        m = t["metadata"]
        return once(_leaf("plan", m["plan"]), lambda plan: _made(F.when(t.isNotNull(), canonical("turn", text_part(t["role"]), text_part(t["text"]), text_part(t["timestamp"]), id_part(plan["id"]), list_part(m["tools_used"]), text_part(m["fallback"]))), plan=plan))

    return F.transform("turns", one)


def _pipeline() -> Column:
    """Every pipeline turn in order, with its ``snapshot`` and the ``facts`` of that."""
    def snapshot(s: Column, facts: Column) -> Column:
        return _made(F.when(s.isNotNull(), canonical("memory_snapshot", list_part(facts, lambda f: id_part(f["id"])), list_part(s["support_facts"]), map_part(s["slots"], map_part), list_part(s["unresolved_goals"]))), facts=facts)

    def one(p: Column) -> Column:
        s = p["memory_snapshot"]
        held = once(F.transform(s["user_facts"], lambda f: _leaf("user_fact", f)), lambda facts: snapshot(s, facts))
        return once(held, lambda h: _made(F.when(p.isNotNull(), canonical("pipeline_turn", text_part(p["turn"]), text_part(p["user_response"]), text_part(p["support_response"]), text_part(p["reflection_score"]), id_part(h["id"]), map_part(p["timings_ms"], number_part))), snapshot=h))

    return F.transform("pipeline_turns", one)


_META_TEXTS = ["generated_at", "model_version", "llm_provider", "stop_reason", "user_persona_traits", "supportbot_style"]


def _assessment() -> Column:
    q = F.col("metadata.quality_assessment")
    low = lambda c: once(F.lower(strip(c)), text_part)
    return _made(F.when(q.isNotNull(), canonical("assessment", low(q["dialogue_id"]), low(q["domain"]), number_part(q["overall_score"]), text_part(q["passed_filters"]), text_part(q["assessment_timestamp"]))))


def _metadata(assessment: Column) -> Column:
    m = F.col("metadata")
    numbers = [text_part(m["num_turns"]), text_part(m["goal_complexity"]), number_part(m["quality_score"]), number_part(m["generation_time_seconds"])]
    return _made(F.when(m.isNotNull(), canonical("metadata", *[text_part(m[c]) for c in _META_TEXTS], *numbers, id_part(assessment["id"]))))


def bridge(dialogues: DataFrame) -> DataFrame:
    """``child, rec_id, pos, item, node_id, parent_id, body``: one row per object of every record.

    ``record`` rows have no parent; ``turn``, ``pipeline_turn`` and ``metadata``
    hang on the record, ``memory_snapshot`` on its pipeline turn. The child
    tables: ``plan`` rows are the non-blank plans of turns (pos = turn, item =
    0), ``user_fact`` rows the non-blank facts of memory snapshots (pos =
    position in ``pipeline_turns``, item = position in the stored array), and
    each non-null quality assessment is ``assessment``, or
    ``assessment_broken`` if its dialogue id is null or not that of its record
    (case and outer white space aside). Null structs, arrays and elements give
    no rows but keep the positions of the others. Two records stored with one
    content have one identity: ``rec_id``, snapshot and time of storage are
    theirs alone. Extra columns are ignored; every ``parent_id`` is the
    ``node_id`` of a row of the same record.
    """
    base = dialogues.select("rec_id", "dialogue_id", "goal", "domain", "context", "user_persona", "metadata", _turns().alias("ts"), _pipeline().alias("ps"), _assessment().alias("qa"))
    base = base.withColumn("meta", _metadata(F.col("qa")))
    ids = lambda a: list_part(a, lambda x: id_part(x["id"]))
    record = canonical("record", *[text_part(F.col(c)) for c in ("dialogue_id", "goal", "domain", "context", "user_persona")], ids(F.col("ts")), ids(F.col("ps")), id_part(F.col("meta.id")))
    base = base.withColumn("rec", _made(record))
    same = F.coalesce(F.lower(strip(F.col("metadata.quality_assessment.dialogue_id"))) == F.lower(strip(F.col("dialogue_id"))), F.lit(False))
    top = F.col("rec.id")
    if_there = lambda x, row: F.when(x.isNotNull(), row)
    turn = lambda t, i: F.array(if_there(t, _row("turn", i, 0, t, top)), if_there(t["plan"], _row("plan", i, 0, t["plan"], t["id"])))

    def pair(p: Column, k: Column) -> Column:
        s = p["snapshot"]
        facts = F.transform(s["facts"], lambda f, j: if_there(f, _row("user_fact", k, j, f, s["id"])))
        return F.concat(F.array(if_there(p, _row("pipeline_turn", k, 0, p, top)), if_there(s, _row("memory_snapshot", k, 0, s, p["id"]))), F.coalesce(facts, F.array()))

    rest = F.array(
        _row("record", 0, 0, F.col("rec"), F.lit(None).cast("string")),
        if_there(F.col("meta"), _row("metadata", 0, 0, F.col("meta"), top)),
        if_there(F.col("qa"), _row(F.when(same, "assessment").otherwise("assessment_broken"), 0, 0, F.col("qa"), F.col("meta.id"))),
    )
    none = F.array()
    all_of = F.concat(rest, F.coalesce(F.flatten(F.transform("ts", turn)), none), F.coalesce(F.flatten(F.transform("ps", pair)), none))
    flat = base.select("rec_id", F.explode(F.filter(all_of, lambda c: c.isNotNull())).alias("c"))
    return flat.select("c.child", "rec_id", "c.pos", "c.item", "c.node_id", "c.parent_id", "c.body")


def children(dialogues: DataFrame) -> DataFrame:
    """The bridge rows of the child tables; see ``bridge``."""
    return bridge(dialogues).where(F.col("child").isin(CHILDREN))


def objects(bridge_rows: DataFrame) -> DataFrame:
    """``node_id, body, n_occurrences``: every distinct object once.

    Hot objects are combined on the map side before the shuffle on their hash.
    """
    return bridge_rows.groupBy("node_id").agg(F.min("body").alias("body"), F.count("*").alias("n_occurrences"))
