"""Queries of the core operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnloom.operators import nested, schema_drift
from turnloom.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "snapshot_records"))


def p4_consistent(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent(table(spark, d, "snapshot_records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.children(table(spark, d, "dialogues")).select("child", "rec_id", "pos", "item")


def p7_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridge(table(spark, d, "dialogues")).select("child", "rec_id", "pos", "item", "node_id", "parent_id")


def p7_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(nested.bridge(table(spark, d, "dialogues")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_consistent, p7_found, p7_bridge, p7_objects)}


_EDGE = r"'^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$', '', 'g'"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, {_EDGE})"


# canonical texts in SQL: a value with its length, lists, maps
_t = lambda v: f"coalesce(length(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '~')"
_i = lambda v: f"coalesce(sha256({v}), '~')"
_n = lambda v: _t(f"CASE WHEN isnan({v}) THEN 'nan' ELSE CAST(CAST({v} AS DECIMAL(38, 9)) AS VARCHAR) END")
_list = lambda v, f: f"coalesce('[' || array_to_string(list_transform({v}, lambda x: {f('x')}), '') || ']', '~')"
_map = lambda v, f, x="k": f"coalesce('{{' || array_to_string(list_transform(list_sort(map_keys({v})), lambda {x}: {_t(x)} || {f(f'({v})[{x}]')}), '') || '}}', '~')"
_leaf = lambda kind, v: f"CASE WHEN {_strip(v)} <> '' THEN '{kind}|' || {_t(_strip(v))} END"
_META = ["generated_at", "model_version", "llm_provider", "stop_reason", "user_persona_traits", "supportbot_style"]
_NODES = f"""
    WITH TR AS (SELECT rec_id, unnest(turns) AS t, generate_subscripts(turns, 1) - 1 AS pos FROM dialogues),
    T1 AS (SELECT rec_id, pos, t, {_leaf('plan', 't.metadata.plan')} AS plan FROM TR WHERE t IS NOT NULL),
    T AS (SELECT rec_id, pos, plan, 'turn|' || {_t('t.role')} || {_t('t.text')} || {_t('t.timestamp')} || {_i('plan')} || {_list('t.metadata.tools_used', _t)} || {_t('t.metadata.fallback')} AS body FROM T1),
    PR AS (SELECT rec_id, unnest(pipeline_turns) AS p, generate_subscripts(pipeline_turns, 1) - 1 AS pos FROM dialogues),
    P1 AS (SELECT rec_id, pos, p, list_transform(p.memory_snapshot.user_facts, lambda f: {_leaf('user_fact', 'f')}) AS facts FROM PR WHERE p IS NOT NULL),
    P2 AS (SELECT rec_id, pos, p, facts, CASE WHEN p.memory_snapshot IS NOT NULL THEN 'memory_snapshot|' || {_list('facts', _i)} || {_list('p.memory_snapshot.support_facts', _t)} || {_map('p.memory_snapshot.slots', lambda v: _map(v, _t, 'k2'))} || {_list('p.memory_snapshot.unresolved_goals', _t)} END AS snapshot FROM P1),
    P AS (SELECT rec_id, pos, facts, snapshot, 'pipeline_turn|' || {_t('p.turn')} || {_t('p.user_response')} || {_t('p.support_response')} || {_t('p.reflection_score')} || {_i('snapshot')} || {_map('p.timings_ms', _n)} AS body FROM P2),
    F AS (SELECT rec_id, pos, snapshot, unnest(facts) AS fact, generate_subscripts(facts, 1) - 1 AS item FROM P),
    M0 AS (SELECT rec_id, dialogue_id, metadata AS m, metadata.quality_assessment AS q FROM dialogues),
    M1 AS (SELECT *, CASE WHEN q IS NOT NULL THEN 'assessment|' || {_t(f"lower({_strip('q.dialogue_id')})")} || {_t(f"lower({_strip('q.domain')})")} || {_n('q.overall_score')} || {_t('q.passed_filters')} || {_t('q.assessment_timestamp')} END AS qa FROM M0),
    M AS (SELECT rec_id, qa, coalesce(lower({_strip('q.dialogue_id')}) = lower({_strip('dialogue_id')}), false) AS same,
        CASE WHEN m IS NOT NULL THEN 'metadata|' || {' || '.join(_t('m.' + c) for c in _META)} || {_t('m.num_turns')} || {_t('m.goal_complexity')} || {_n('m.quality_score')} || {_n('m.generation_time_seconds')} || {_i('qa')} END AS body FROM M1),
    TI AS (SELECT TR.rec_id, '[' || string_agg({_i('T.body')}, '' ORDER BY TR.pos) || ']' AS ids FROM TR LEFT JOIN T USING (rec_id, pos) GROUP BY 1),
    PI AS (SELECT PR.rec_id, '[' || string_agg({_i('P.body')}, '' ORDER BY PR.pos) || ']' AS ids FROM PR LEFT JOIN P USING (rec_id, pos) GROUP BY 1),
    R AS (SELECT d.rec_id, 'record|' || {' || '.join(_t('d.' + c) for c in ('dialogue_id', 'goal', 'domain', 'context', 'user_persona'))} || CASE WHEN d.turns IS NULL THEN '~' ELSE coalesce(TI.ids, '[]') END
        || CASE WHEN d.pipeline_turns IS NULL THEN '~' ELSE coalesce(PI.ids, '[]') END || {_i('M.body')} AS body FROM dialogues d LEFT JOIN TI USING (rec_id) LEFT JOIN PI USING (rec_id) JOIN M USING (rec_id)),
    N AS (SELECT 'record' AS child, rec_id, 0 AS pos, 0 AS item, body, NULL AS parent FROM R
        UNION ALL SELECT 'turn', rec_id, pos, 0, T.body, R.body FROM T JOIN R USING (rec_id)
        UNION ALL SELECT 'plan', rec_id, pos, 0, plan, body FROM T WHERE plan IS NOT NULL
        UNION ALL SELECT 'pipeline_turn', rec_id, pos, 0, P.body, R.body FROM P JOIN R USING (rec_id)
        UNION ALL SELECT 'memory_snapshot', rec_id, pos, 0, snapshot, body FROM P WHERE snapshot IS NOT NULL
        UNION ALL SELECT 'user_fact', rec_id, pos, item, fact, snapshot FROM F WHERE fact IS NOT NULL
        UNION ALL SELECT 'metadata', rec_id, 0, 0, M.body, R.body FROM M JOIN R USING (rec_id) WHERE M.body IS NOT NULL
        UNION ALL SELECT CASE WHEN same THEN 'assessment' ELSE 'assessment_broken' END, rec_id, 0, 0, qa, body FROM M WHERE qa IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    same = f"lower({_strip('metadata.quality_assessment.dialogue_id')}) = lower({_strip('dialogue_id')})"
    return {
        "p7_found": f"""
            WITH plans AS (SELECT rec_id, turns, unnest(range(len(turns))) AS pos FROM dialogues),
            snaps AS (SELECT rec_id, pipeline_turns, unnest(range(len(pipeline_turns))) AS pos FROM dialogues),
            facts AS (SELECT rec_id, pos, pipeline_turns[pos + 1].memory_snapshot.user_facts AS facts FROM snaps),
            fact AS (SELECT rec_id, pos, facts, unnest(range(len(facts))) AS item FROM facts)
            SELECT 'plan' AS child, rec_id, CAST(pos AS INTEGER) AS pos, 0 AS item FROM plans
            WHERE {_strip('turns[pos + 1].metadata.plan')} <> ''
            UNION ALL
            SELECT 'user_fact', rec_id, CAST(pos AS INTEGER), CAST(item AS INTEGER) FROM fact WHERE {_strip('facts[item + 1]')} <> ''
            UNION ALL
            SELECT CASE WHEN {same} THEN 'assessment' ELSE 'assessment_broken' END, rec_id, 0, 0
            FROM dialogues WHERE metadata.quality_assessment IS NOT NULL""",
        "p7_bridge": f"{_NODES} SELECT child, rec_id, CAST(pos AS INTEGER) AS pos, CAST(item AS INTEGER) AS item, sha256(body) AS node_id, sha256(parent) AS parent_id FROM N",
        "p7_objects": f"{_NODES} SELECT sha256(body) AS node_id, min(body) AS body, count(*) AS n_occurrences FROM N GROUP BY 1",
    }
