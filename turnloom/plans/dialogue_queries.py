"""Queries over dialogue records: checks, failures, metrics, selections and exports, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import stats as S
from turnloom.functions import text as X
from turnloom.operators import dialogues as D
from turnloom.operators import memory, nearest, reports
from turnloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_ALL = "(all)"
_EDGE = r"'^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$', '', 'g'"
_strip = lambda c: f"regexp_replace({c}, {_EDGE})"
_clean = lambda c: rf"trim(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'))"
_pieces = lambda c: f"list_distinct(list_filter(string_split(lower({_clean(c)}), ' '), lambda w: w <> ''))"
_words = lambda c: rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
_any = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in ws) + ")"
_jaccard = lambda a, b: f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END)"

_DOMAIN = f"coalesce(nullif(lower({_strip('domain')}), ''), 'unknown')"
#: D: the common form of records; T: one row per turn; P: neighbouring turns; W: texts of a dialogue.
_CTE = f"""
    D AS (SELECT rec_id, version_id, dialogue_id, coalesce(goal, '') AS goal, {_DOMAIN} AS domain,
            CASE WHEN NOT isnan(metadata.quality_score) THEN metadata.quality_score END AS score,
            list_filter(coalesce(turns, []), lambda t: t IS NOT NULL) AS turns FROM dialogues),
    T0 AS (SELECT rec_id, domain, goal, score, unnest(turns) AS t, generate_subscripts(turns, 1) AS i, len(turns) AS n FROM D),
    T AS (SELECT rec_id, domain, goal, score, i, n, coalesce(t.role, '') AS role, coalesce(t.text, '') AS text FROM T0),
    W AS (SELECT rec_id, lower(string_agg(text, ' ' ORDER BY i)) AS body FROM T GROUP BY rec_id),
    P0 AS (SELECT rec_id, domain, i, text, lag(text) OVER (PARTITION BY rec_id ORDER BY i) AS prev FROM T),
    P AS (SELECT rec_id, domain, i, length({_strip('text')}) AS la, length({_strip('prev')}) AS lb, {_pieces('text')} AS a, {_pieces('prev')} AS b FROM P0 WHERE prev IS NOT NULL)"""

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, ctes: bool = True):
    def wrap(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = (f"WITH {_CTE}{sql}" if ctes and sql.lstrip().startswith(",") else f"WITH {_CTE} {sql}" if ctes else sql)
        return f

    return wrap


def _d(spark: SparkSession, d: str) -> DataFrame:
    return D.normal(table(spark, d, "dialogues"))


def _by_domain(rows: DataFrame, *aggs: Column) -> DataFrame:
    """The aggregates overall and per domain in one pass."""
    return rows.rollup("domain").agg(*aggs).withColumn("domain", F.coalesce("domain", F.lit(_ALL)))


_r = lambda c, name: F.round(c, 6).alias(name)


@_query("""SELECT rec_id, coalesce(dialogue_id IS NOT NULL AND d.goal IS NOT NULL AND d.domain IS NOT NULL AND turns IS NOT NULL
    AND len(list_filter(turns, lambda t: t IS NULL OR t.text IS NULL OR t.role IS NULL OR t.role NOT IN ('User', 'SupportBot'))) = 0, false) AS valid FROM dialogues d""")
def v1_format_valid(spark, d):
    ok = F.forall("turns", lambda t: t.isNotNull() & t["text"].isNotNull() & F.coalesce(t["role"].isin("User", "SupportBot"), F.lit(False)))
    return table(spark, d, "dialogues").select("rec_id", F.coalesce(F.col("dialogue_id").isNotNull() & F.col("goal").isNotNull() & F.col("domain").isNotNull() & F.col("turns").isNotNull() & ok, F.lit(False)).alias("valid"))


@_query("SELECT rec_id, score FROM D WHERE coalesce(score, 0) >= 0.7")
def v2_quality_threshold(spark, d):
    return _d(spark, d).where(F.coalesce("score", F.lit(0.0)) >= 0.7).select("rec_id", "score")


@_query(f""", C AS (SELECT D.rec_id,
        len(turns) BETWEEN {D.MIN_TURNS} AND {D.MAX_TURNS} AS length_ok,
        NOT EXISTS (SELECT 1 FROM P WHERE P.rec_id = D.rec_id AND {_jaccard('a', 'b')} > {D.REPEATED}) AS repetition_ok,
        NOT coalesce((SELECT {_any('body', D.PROFANE)} FROM W WHERE W.rec_id = D.rec_id), false) AS language_ok,
        len(turns) >= 2 AND NOT EXISTS (SELECT 1 FROM T WHERE T.rec_id = D.rec_id AND (role <> CASE WHEN i % 2 = 1 THEN 'User' ELSE 'SupportBot' END OR {_strip('text')} = '')) AS roles_ok,
        coalesce((SELECT len(list_filter({_pieces('D.goal')}, lambda w: contains(body, w))) > 0 FROM W WHERE W.rec_id = D.rec_id), false) AS goal_ok,
        NOT EXISTS (SELECT 1 FROM T WHERE T.rec_id = D.rec_id AND length({_strip('text')}) < 3) AS answers_ok FROM D)
    SELECT *, round((length_ok::INT + repetition_ok::INT + language_ok::INT + roles_ok::INT + goal_ok::INT + answers_ok::INT) / 6.0, 6)::DOUBLE AS heuristic FROM C""")
def v9_heuristic_checks(spark, d):
    return D.checks(_d(spark, d)).drop("domain", "score").withColumn("heuristic", F.round("heuristic", 6))


@_query(f"SELECT D.rec_id, EXISTS (SELECT 1 FROM T WHERE T.rec_id = D.rec_id AND i > n - 3 AND role = 'User' AND {_any('lower(text)', D.SATISFIED)}) AS satisfied FROM D")
def v14_goal_satisfied(spark, d):
    return _d(spark, d).select("rec_id", D.satisfied().alias("satisfied"))


_MET = " AND ".join(f"(regexp_extract(lower(goal), '{p}', 1) = '' OR contains(body, regexp_extract(lower(goal), '{p}', 1)))" for p in D.CONSTRAINTS.values())
_ASKED = "list_filter([" + ", ".join(f"'{r}'" for r in D.REQUESTABLE) + "], lambda r: contains(lower(goal), r))"


@_query(f"""SELECT D.rec_id, {_MET} AND len(list_filter({_ASKED}, lambda r: contains(body, r))) * 2 >= len({_ASKED}) AND {_any('body', D.COMPLETED)} AS completed
    FROM D JOIN (SELECT D.rec_id, coalesce(body, '') AS body FROM D LEFT JOIN W USING (rec_id)) USING (rec_id)""")
def v19_goal_completion(spark, d):
    return _d(spark, d).select("rec_id", D.goal_completion().alias("completed"))


# literals of its own, so that a wrong constant of the plan shows
_CONFIRMED = " OR ".join(
    f"({asked} AND instr(body, '{w}') > 0 AND regexp_matches(substr(body, instr(body, '{w}'), 200), 'yes|confirmed|done|booked|found'))"
    for asked, said in (("regexp_matches(lower(goal), 'book|reserve')", ["book", "reserve", "booking", "reservation"]), ("regexp_matches(lower(goal), 'find|search')", ["find", "search", "looking for"]), ("regexp_matches(lower(goal), 'information|details')", ["information", "details", "tell me"]))
    for w in said
)


@_query(f""", L AS (SELECT rec_id, lower(arg_max(text, i)) AS final FROM T WHERE role = 'User' GROUP BY rec_id)
    SELECT D.rec_id, goal <> '' AND len(turns) > 0 AND regexp_matches(coalesce(final, ''), 'thank|perfect|great|excellent|good|all set|that works|that''ll work|appreciate it') AND (len(turns) >= 4
        OR CASE WHEN regexp_matches(lower(goal), 'book|reserve|find|search|information|details') THEN {_CONFIRMED} ELSE regexp_matches(body, 'thank|perfect|great|excellent') END) AS success
    FROM D JOIN (SELECT D.rec_id, coalesce(body, '') AS body FROM D LEFT JOIN W USING (rec_id)) USING (rec_id) LEFT JOIN L USING (rec_id)""")
def v22_task_success(spark, d):
    return _d(spark, d).select("rec_id", D.task_success().alias("success"))


def _case_rules(alias: str) -> str:
    arms = []
    for name, rules in D.RULES.items():
        counts = ["1" if when is None else f"regexp_matches(lower(goal), '{when}')::INT" for when, _ in rules]
        met = [f"{c} * regexp_matches({alias}, '{then}')::INT" for c, (_, then) in zip(counts, rules)]
        arms.append(f"WHEN domain = '{name}' THEN ({' + '.join(met)}) / CAST({' + '.join(counts)} AS DOUBLE)")
    return f"CASE {' '.join(arms)} WHEN c OR b THEN 1.0 ELSE 0.0 END"


_COMMITMENT = D.COMMITMENT.replace("'", "''")


@_query(f""", X AS (SELECT D.rec_id, D.domain, D.goal, concat_ws(' ', coalesce(body, ''), lower(D.goal), lower(coalesce(r.context, ''))) AS blob FROM D JOIN dialogues r USING (rec_id) LEFT JOIN W USING (rec_id)),
    Y AS (SELECT *, {_any('blob', D.CLOSURE)} AS c, regexp_matches(blob, '{_COMMITMENT}') AS b FROM X), Z AS (SELECT rec_id, c, b, round({D.RULE_WEIGHT} * ({_case_rules('blob')}) + {D.BONUS} * CASE WHEN c AND b THEN 1.0 ELSE {D.BONUS} END, 4)::DOUBLE AS score FROM Y)
    SELECT rec_id, score, score >= {D.COMPLETE_LEAST} AND c AND b AS complete FROM Z""")
def v18_rule_completion(spark, d):
    return _d(spark, d).select("rec_id", D.rule_completion().alias("r")).select("rec_id", "r.score", "r.complete")


@_query(f"SELECT rec_id FROM T WHERE i = n AND role = 'User' AND {_strip('text')} <> '' AND {_any(f'lower({_strip(chr(116) + chr(101) + chr(120) + chr(116))})', D.OPEN)}")
def v24_open_requests(spark, d):
    return _d(spark, d).where(D.open_request()).select("rec_id")


@_query(f""", L AS (SELECT rec_id, i, n, role, lower({_strip('text')}) AS s, row_number() OVER (PARTITION BY rec_id, role ORDER BY i DESC) AS back FROM T),
    K AS (SELECT rec_id, i, n, role, s, back, CASE WHEN role = 'User' THEN {_any('s', D.THANKS)} OR length(s) < 60 ELSE {_any('s', D.GOODBYE)} END AS f4, CASE WHEN role = 'User' THEN {_any('s', D.THANKS)} OR length(s) < 50 ELSE {_any('s', D.GOODBYE)} END AS f6
        FROM L WHERE role IN ('User', 'SupportBot')),
    R4 AS (SELECT rec_id FROM K WHERE n >= 4 AND i > n - 4 GROUP BY 1 HAVING count(*) FILTER (role = 'User') >= 1 AND count(*) FILTER (role = 'SupportBot') >= 1 AND bool_and(f4)),
    R6 AS (SELECT rec_id FROM K WHERE n >= 6 AND i > n - 6 GROUP BY 1 HAVING count(*) FILTER (role = 'User') >= 2 AND count(*) FILTER (role = 'SupportBot') >= 2 AND bool_and(f6) FILTER (back <= 2)),
    B AS (SELECT rec_id, i, n, {_pieces('text')} AS w FROM T WHERE n >= 8 AND i > n - 8),
    RS AS (SELECT x.rec_id FROM B x JOIN B y ON x.rec_id = y.rec_id AND y.i = x.i - 4 WHERE x.i > x.n - 4 GROUP BY 1 HAVING sum({_jaccard('x.w', 'y.w')}) / 4 >= {D.LOOP})
    SELECT rec_id FROM R4 UNION SELECT rec_id FROM R6 UNION SELECT rec_id FROM RS""")
def v23_repetition_loops(spark, d):
    return _d(spark, d).where(D.loop()).select("rec_id")


_stop = "[" + ", ".join(f"'{w}'" for w in D.STOP) + "]"
_content = lambda c: f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9'']+')), lambda w: length(w) > 1 AND NOT list_contains({_stop}, w))"


@_query(f""", H AS (SELECT rec_id, n, string_agg(CASE WHEN i <= greatest(2, n // 2) THEN text END, ' ' ORDER BY i) AS f, string_agg(CASE WHEN i > greatest(2, n // 2) THEN text END, ' ' ORDER BY i) AS r FROM T GROUP BY rec_id, n),
    O AS (SELECT D.rec_id, n, {_content('goal')} AS g, {_content('f')} AS cf, {_content('r')} AS cr FROM D JOIN H USING (rec_id)),
    R AS (SELECT rec_id, n, len(g) AS k, len(list_intersect(g, cf)) / CAST(greatest(len(g), 1) AS DOUBLE) AS o1, len(list_intersect(g, cr)) / CAST(greatest(len(g), 1) AS DOUBLE) AS o2 FROM O)
    SELECT rec_id FROM R WHERE n >= 4 AND k >= 3 AND o1 >= {D.DRIFT_FIRST} AND o2 < {D.DRIFT_PART} * o1 AND o2 < {D.DRIFT_MOST}""")
def v25_goal_drift(spark, d):
    return _d(spark, d).where(D.drift()).select("rec_id")


_NAMES, _CODES = r"regexp_extract_all(text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b')", r"regexp_extract_all(text, '\b(?:[A-Z]{2,}-\d{2,}|[A-Z]{3,}\d{3,})\b')"


@_query(f""", B AS (SELECT rec_id, i, role, text, lower(concat_ws(' ', goal, coalesce(string_agg(text, ' ') OVER (PARTITION BY rec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''))) AS earlier FROM T),
    E0 AS (SELECT rec_id, i, earlier, list_concat(list_filter({_NAMES}, lambda e: length(e) >= 8), {_CODES}) AS said FROM B WHERE role = 'SupportBot'),
    E AS (SELECT rec_id, i, earlier, unnest(said) AS e, generate_subscripts(said, 1) AS k FROM E0)
    SELECT rec_id, string_agg(e, '|' ORDER BY i, k) AS entities FROM (SELECT * FROM E WHERE NOT contains(earlier, lower(e)) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY i, k) <= 4) GROUP BY 1""")
def v26_unknown_entities(spark, d):
    return _d(spark, d).select("rec_id", D.entities().alias("e")).where(F.size("e") > 0).select("rec_id", F.array_join("e", "|").alias("entities"))


@_query(f""", U AS (SELECT rec_id, i, {_pieces('text')} AS w FROM T WHERE role = 'User' AND length({_strip('text')}) >= {D.QUESTION_LEAST})
    SELECT DISTINCT x.rec_id FROM U x JOIN U y ON x.rec_id = y.rec_id AND x.i < y.i WHERE {_jaccard('x.w', 'y.w')} >= {D.QUESTION_ALIKE}""")
def v27_repeated_questions(spark, d):
    return _d(spark, d).where(D.repeated_question()).select("rec_id")


@_query("""SELECT D.rec_id, string_agg(w, '|' ORDER BY k) AS missing FROM (SELECT D.*, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT D.*, CASE domain WHEN 'hotel' THEN ['area', 'price_range', 'stars', 'parking', 'internet', 'number', 'check']
        WHEN 'restaurant' THEN ['area', 'food_type', 'cuisine', 'price_range', 'number', 'time'] WHEN 'taxi' THEN ['departure', 'destination', 'time', 'number'] WHEN 'train' THEN ['departure', 'destination', 'date', 'time', 'number']
        WHEN 'attraction' THEN ['area', 'type', 'opening', 'date'] WHEN 'technical_support' THEN ['problem', 'symptom', 'diagnostic', 'resolution', 'user'] ELSE ['relevant'] END AS ws FROM D) D) D LEFT JOIN W USING (rec_id)
    WHERE contains(lower(goal), w) AND NOT contains(coalesce(body, ''), w) GROUP BY 1""")
def v28_forgotten_slots(spark, d):
    return D.spoken(_d(spark, d)).select("rec_id", D.forgotten_slots().alias("m")).where(F.size("m") > 0).select("rec_id", F.array_join("m", "|").alias("missing"))


@_query(f""", L AS (SELECT rec_id, lower(arg_max(text, i)) AS final FROM T WHERE role = 'User' GROUP BY rec_id)
    SELECT rec_id FROM L JOIN ({_SQL['v18_rule_completion']}) USING (rec_id) WHERE regexp_matches(final, 'thank|perfect|bye|that''s all|all set') AND NOT complete""")
def v30_early_termination(spark, d):
    return D.spoken(_d(spark, d)).where(D.early_termination()).select("rec_id")


@_query(f"""SELECT rec_id, CAST(count(*) AS INTEGER) AS n_breaks FROM (SELECT rec_id, i FROM P WHERE la >= {D.INCOHERENT_LEAST} AND lb >= {D.INCOHERENT_LEAST} AND {_jaccard('a', 'b')} < {D.INCOHERENT}
    QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY i) <= 8) GROUP BY rec_id""")
def v29_incoherent_transitions(spark, d):
    return _d(spark, d).select("rec_id", F.size(D.incoherent()).alias("n_breaks")).where("n_breaks > 0")


@_query(f"""SELECT coalesce(domain, '{_ALL}') AS domain, count(*) AS total, count(*) FILTER (s) AS satisfied, round(count(*) FILTER (s) / CAST(count(*) AS DOUBLE), 6) AS share
    FROM (SELECT D.domain, EXISTS (SELECT 1 FROM T WHERE T.rec_id = D.rec_id AND i > n - 3 AND role = 'User' AND {_any('lower(text)', D.SATISFIED)}) AS s FROM D) GROUP BY ROLLUP (domain)""")
def a1_goal_relevance(spark, d):
    rows = _d(spark, d).select("domain", D.satisfied().alias("s"))
    return _by_domain(rows, F.count("*").alias("total"), F.count_if("s").alias("satisfied"), _r(F.count_if("s") / F.count("*"), "share"))


@_query(f"""SELECT coalesce(D.domain, '{_ALL}') AS domain, count(*) AS total, round(100.0 * count(*) FILTER (g.completed) / count(*), 6)::DOUBLE AS completion_rate, round(100.0 * count(*) FILTER (t.success) / count(*), 6)::DOUBLE AS success_rate
    FROM D JOIN ({_SQL['v19_goal_completion']}) g USING (rec_id) JOIN ({_SQL['v22_task_success']}) t USING (rec_id) GROUP BY ROLLUP (D.domain)""")
def a2_completion_and_success_rates(spark, d):
    rows = _d(spark, d).select("domain", D.goal_completion().alias("g"), D.task_success().alias("t"))
    return _by_domain(rows, F.count("*").alias("total"), _r(100 * F.count_if("g") / F.count("*"), "completion_rate"), _r(100 * F.count_if("t") / F.count("*"), "success_rate"))


_BODYWORDS = f"""W2 AS (SELECT D.rec_id, D.domain, {_words("coalesce(body, '')")} AS w FROM D LEFT JOIN W USING (rec_id)),
    G AS (SELECT rec_id, domain, w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) AS b FROM W2 WHERE len(w) > 0),
    G2 AS (SELECT rec_id, domain, len(list_distinct(w)) / CAST(len(w) AS DOUBLE) AS d1, CASE WHEN len(b) = 0 THEN 0.0 ELSE len(list_distinct(b)) / CAST(len(b) AS DOUBLE) END AS d2 FROM G)"""


def _distinct(spark, d) -> DataFrame:
    w = _d(spark, d).select("rec_id", "domain", X.words(D.whole()).alias("w")).where(F.size("w") > 0)
    return w.select("rec_id", "domain", X.distinct_share(F.col("w")).alias("d1"), X.distinct_share(X.bigrams(F.col("w"))).alias("d2"))


@_query(f", {_BODYWORDS} SELECT coalesce(domain, '{_ALL}') AS domain, count(*) AS n, round(avg(d1), 6) AS distinct_1, round(avg(d2), 6) AS distinct_2, round((avg(d1) + avg(d2)) / 2, 6) AS combined FROM G2 GROUP BY ROLLUP (domain)")
def a6_distinct_n(spark, d):
    return _by_domain(_distinct(spark, d), F.count("*").alias("n"), _r(F.avg("d1"), "distinct_1"), _r(F.avg("d2"), "distinct_2"), _r((F.avg("d1") + F.avg("d2")) / 2, "combined"))


@_query(f", {_BODYWORDS} SELECT count(*) AS total_words, count(DISTINCT x) AS distinct_words, round(100.0 * count(DISTINCT x) / count(*), 6)::DOUBLE AS ratio FROM (SELECT unnest(w) AS x FROM W2)")
def a7_type_token_ratio(spark, d):
    each = _d(spark, d).select(F.explode(X.words(D.whole())).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.count("*").alias("distinct_words"), _r(100 * F.count("*") / F.sum("n"), "ratio"))


@_query(f""", N AS (SELECT D.rec_id, D.domain, len(turns) AS t, coalesce((SELECT sum(len({_words('text')})) FROM T WHERE T.rec_id = D.rec_id), 0) AS w, coalesce((SELECT sum(length(text)) FROM T WHERE T.rec_id = D.rec_id), 0) AS c FROM D)
    SELECT coalesce(domain, '{_ALL}') AS domain, count(*) AS n, round(avg(t), 6) AS turns_mean, round(coalesce(stddev_samp(t), 0), 6) AS turns_std, min(t)::INT AS turns_min, max(t)::INT AS turns_max,
        round(avg(w), 6) AS words_mean, round(coalesce(stddev_samp(w), 0), 6) AS words_std, round(avg(c), 6) AS chars_mean, round(coalesce(stddev_samp(c), 0), 6) AS chars_std FROM N GROUP BY ROLLUP (domain)""")
def a8_length_metrics(spark, d):
    total = lambda f: F.aggregate(F.transform("turns", lambda t: f(t["text"])), F.lit(0), lambda a, x: a + x)
    rows = _d(spark, d).select("domain", F.size("turns").alias("t"), total(lambda s: F.size(X.words(s))).alias("w"), total(F.length).alias("c"))
    sd = lambda c, name: _r(F.coalesce(F.stddev_samp(c), F.lit(0.0)), name)
    return _by_domain(rows, F.count("*").alias("n"), _r(F.avg("t"), "turns_mean"), sd("t", "turns_std"), F.min("t").alias("turns_min"), F.max("t").alias("turns_max"), _r(F.avg("w"), "words_mean"), sd("w", "words_std"), _r(F.avg("c"), "chars_mean"), sd("c", "chars_std"))


@_query(f""", R AS (SELECT {_DOMAIN} AS domain, count(*) AS incoming, round(avg(len(list_filter(coalesce(turns, []), lambda t: t IS NOT NULL))), 6) AS incoming_turns FROM incoming_dialogues GROUP BY 1)
    SELECT domain, stored, incoming, stored_turns, incoming_turns, round(CASE WHEN incoming_turns = 0 THEN 0 ELSE stored_turns / incoming_turns END, 6) AS turn_ratio
    FROM (SELECT domain, count(*) AS stored, round(avg(len(turns)), 6) AS stored_turns FROM D GROUP BY 1) JOIN R USING (domain)""")
def a10_domain_analysis(spark, d):
    fresh = D.normal(table(spark, d, "incoming_dialogues").select(F.col("incoming_id").alias("rec_id"), F.lit("").alias("version_id"), "dialogue_id", "goal", "domain", F.lit("").alias("context"), "turns", F.struct(F.lit(None).cast("double").alias("quality_score"), F.lit(None).cast("string").alias("model_version")).alias("metadata")))
    side = lambda rows, name: rows.groupBy("domain").agg(F.count("*").alias(name), _r(F.avg(F.size("turns")), f"{name}_turns"))
    return side(_d(spark, d), "stored").join(side(fresh, "incoming"), "domain").withColumn("turn_ratio", F.round(S.ratio(F.col("stored_turns"), F.col("incoming_turns")), 6))


@_query(f""", X AS (SELECT rec_id, domain, count(*) AS n, count(DISTINCT {_strip('text')}) AS k FROM T WHERE {_strip('text')} <> '' GROUP BY 1, 2)
    SELECT coalesce(domain, '{_ALL}') AS domain, count(*) AS n, round(avg(1 - k / CAST(n AS DOUBLE)), 6) AS mean, round(stddev_pop(1 - k / CAST(n AS DOUBLE)), 6) AS std FROM X WHERE n >= 2 GROUP BY ROLLUP (domain)""")
def a11_repetition_rate(spark, d):
    said = F.filter(F.transform(D.texts(), lambda s: D.strip(s)), lambda s: s != "")
    rows = _d(spark, d).select("domain", said.alias("s")).where(F.size("s") >= 2).select("domain", (1 - X.distinct_share(F.col("s"))).alias("r"))
    return _by_domain(rows, F.count("*").alias("n"), _r(F.avg("r"), "mean"), _r(F.stddev_pop("r"), "std"))


@_query(rf""", S0 AS (SELECT rec_id, {_DOMAIN} AS domain, unnest(turns) AS t, generate_subscripts(turns, 1) AS i FROM dialogues),
    S1 AS (SELECT rec_id, domain, i, try_cast(t.timestamp AS TIMESTAMP) AS ts FROM S0 WHERE regexp_matches(t.timestamp, '^\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{{1,6}})?$')),
    S2 AS (SELECT domain, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY rec_id ORDER BY i))) / 1e6 AS gap FROM S1 WHERE ts IS NOT NULL)
    SELECT coalesce(domain, '{_ALL}') AS domain, count(*) AS n, round(avg(gap), 5) AS mean, round(stddev_pop(gap), 5) AS std, round(greatest(min(gap), 0.1), 5) AS min, round(max(gap), 5) AS max
    FROM S2 WHERE gap >= 0 AND gap < 86400 GROUP BY ROLLUP (domain)""")
def a12_response_gaps(spark, d):
    raw = table(spark, d, "dialogues")
    name = F.lower(D.strip(F.col("domain")))
    stamp = lambda t: F.when(F.regexp_like(t["timestamp"], F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?$")), F.unix_micros(F.try_to_timestamp(t["timestamp"])))
    known = F.filter(F.transform("turns", stamp), lambda x: x.isNotNull())
    n = F.greatest(F.size("ts") - 1, F.lit(0))
    rows = raw.select(F.when(name.isNull() | (name == ""), "unknown").otherwise(name).alias("domain"), known.alias("ts")).where(F.size("ts") > 1)
    gaps = rows.select("domain", F.explode(F.zip_with(F.slice("ts", F.lit(1), n), F.slice("ts", F.lit(2), n), lambda a, b: (b - a) / 1e6)).alias("g")).where("g >= 0 AND g < 86400")
    return _by_domain(gaps, F.count("*").alias("n"), F.round(F.avg("g"), 5).alias("mean"), F.round(F.stddev_pop("g"), 5).alias("std"), F.round(F.greatest(F.min("g"), F.lit(0.1)), 5).alias("min"), F.round(F.max("g"), 5).alias("max"))


_INTENT_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS intent, rec_id FROM D WHERE {_any('lower(goal)', ws)}" for k, ws in D.INTENTS.items())


@_query(f", I AS ({_INTENT_ROWS}) SELECT intent, count(*) AS n, count(*) FILTER (coalesce({_any('body', D.CONTRADICTION)}, false)) AS contradictions FROM I LEFT JOIN W USING (rec_id) GROUP BY 1")
def a14_intents_and_contradictions(spark, d):
    named = F.filter(F.array(*[F.when(X.holds_any(F.lower("goal"), ws), k) for k, ws in D.INTENTS.items()]), lambda k: k.isNotNull())
    rows = _d(spark, d).select(F.explode(named).alias("intent"), X.holds_any(D.whole(), D.CONTRADICTION).alias("c"))
    return rows.groupBy("intent").agg(F.count("*").alias("n"), F.count_if("c").alias("contradictions"))


@_query(f""", C AS (SELECT rec_id, avg({_jaccard('a', 'b')}) AS c FROM P WHERE la > 0 AND lb > 0 GROUP BY 1), C2 AS (SELECT D.rec_id, D.domain, coalesce(c, 0) AS c FROM D LEFT JOIN C USING (rec_id))
    SELECT coalesce(domain, '{_ALL}') AS domain, count(*) AS n, round(avg(c), 6) AS mean, round(coalesce(stddev_samp(c), 0), 6) AS std FROM C2 GROUP BY ROLLUP (domain)""")
def a15_coherence(spark, d):
    rows = _d(spark, d).select("domain", D.coherence().alias("c"))
    return _by_domain(rows, F.count("*").alias("n"), _r(F.avg("c"), "mean"), _r(F.coalesce(F.stddev_samp("c"), F.lit(0.0)), "std"))


@_query(f""", {_BODYWORDS}, M AS (SELECT 'distinct_1' AS metric, d1 AS x FROM G2 UNION ALL SELECT 'distinct_2', d2 FROM G2)
    SELECT metric, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(avg(x) - 1.96 * stddev_samp(x) / sqrt(count(x)), 6) AS low, round(avg(x) + 1.96 * stddev_samp(x) / sqrt(count(x)), 6) AS high FROM M GROUP BY 1""")
def a18_metric_intervals(spark, d):
    long = _distinct(spark, d).select(F.col("d1").alias("distinct_1"), F.col("d2").alias("distinct_2")).unpivot([], ["distinct_1", "distinct_2"], "metric", "x")
    out = long.groupBy("metric").agg(*S.mean_interval(F.col("x")))
    return out.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")])


@_query(f""", Q AS (SELECT domain, count(*) AS n, count(*) FILTER (score >= 0.7) AS k FROM D GROUP BY 1), Z AS (SELECT *, k / CAST(n AS DOUBLE) AS p, 1.96 * 1.96 AS zz FROM Q)
    SELECT domain, n, k, round(greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n)), 6) AS low,
        round(least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n)), 6) AS high FROM Z""")
def a17_wilson_by_domain(spark, d):
    q = _d(spark, d).groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.7).alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return q.select("domain", "n", "k", _r(low, "low"), _r(high, "high"))


@_query(f""", C AS (SELECT 'goal_drift' AS category, rec_id FROM ({_SQL['v25_goal_drift']}) UNION ALL SELECT 'hallucinated_entities', rec_id FROM ({_SQL['v26_unknown_entities']})
    UNION ALL SELECT 'repeated_questions', rec_id FROM ({_SQL['v27_repeated_questions']}) UNION ALL SELECT 'incoherent_transitions', rec_id FROM ({_SQL['v29_incoherent_transitions']})
    UNION ALL SELECT 'forgotten_slots', rec_id FROM ({_SQL['v28_forgotten_slots']}) UNION ALL SELECT 'early_task_termination', rec_id FROM ({_SQL['v30_early_termination']}))
    SELECT named.category, count(C.rec_id) AS n, round(count(C.rec_id) / CAST((SELECT count(*) FROM D) AS DOUBLE), 6) AS share, round(count(C.rec_id) / CAST((SELECT count(DISTINCT rec_id) FROM C) AS DOUBLE), 6) AS share_of_failed
    FROM (SELECT unnest(['goal_drift', 'hallucinated_entities', 'repeated_questions', 'forgotten_slots', 'incoherent_transitions', 'early_task_termination']) AS category) named LEFT JOIN C ON C.category = named.category GROUP BY 1""")
def a21_failure_report(spark, d):
    return reports.failure_counts(D.failures(_d(spark, d)))


@_query(f"""SELECT s.domain, count(rec_id) AS n, round(coalesce(avg(len(turns)), 0), 6) AS avg_turns FROM (SELECT DISTINCT {_DOMAIN} AS domain FROM keep_targets) s LEFT JOIN D USING (domain) GROUP BY 1""")
def a22_dataset_statistics(spark, d):
    listed = table(spark, d, "keep_targets").select(F.lower(D.strip(F.col("domain"))).alias("domain")).distinct()
    counted = _d(spark, d).groupBy("domain").agg(F.count("*").alias("n"), F.avg(F.size("turns")).alias("t"))
    return listed.join(counted, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("t", F.lit(0.0)), 6).alias("avg_turns"))


@_query("""SELECT version_id, count(*) AS n, round(avg(len(turns)), 6) AS avg_turns, count(DISTINCT domain) AS n_domains,
    CAST(sum(CAST(('0x' || substr(md5(rec_id::VARCHAR || '|' || coalesce(dialogue_id, '') || '|' || goal), 1, 12))::BIGINT AS HUGEINT)) % 1000000000000 AS VARCHAR) AS checksum FROM D GROUP BY 1""")
def a23_version_statistics(spark, d):
    return reports.version_statistics(_d(spark, d))


@_query("""SELECT domain, count(score) AS n, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score) / sqrt(count(score)), 0), 6) AS sem FROM D GROUP BY 1""")
def a25_domain_mean_sem(spark, d):
    return _d(spark, d).groupBy("domain").agg(F.count("score").alias("n"), _r(F.avg("score"), "mean"), _r(S.standard_error(F.col("score")), "sem"))


@_query(""", V AS (SELECT score FROM D WHERE score BETWEEN 0 AND 1), B AS (SELECT least(CAST(floor(score * 20) AS INTEGER), 19) AS bin FROM V)
    SELECT bin, count(*) AS n, round(count(*) / ((SELECT count(*) FROM V) * 0.05), 6) AS density FROM B GROUP BY 1""")
def a26_score_histogram(spark, d):
    v = _d(spark, d).where(F.col("score").between(0, 1))
    counts = v.groupBy(F.least(F.floor(F.col("score") * 20).cast("int"), F.lit(19)).alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.round(F.col("n") / (F.sum("n").over(Window.partitionBy()) * 0.05), 6))


_SCORES = """R AS (SELECT DISTINCT * FROM annotations), E AS (SELECT annotation_id, dialogue_id, annotator_id, unnest(map_entries(dimensions)) AS e FROM R),
    X AS (SELECT dialogue_id, annotator_id, e.key AS dimension, e.value AS score FROM E WHERE e.value IS NOT NULL AND NOT isnan(e.value))"""


def _scores(spark, d) -> DataFrame:
    rated = table(spark, d, "annotations").withColumn("dims", F.map_entries("dimensions")).drop("dimensions").distinct()
    return rated.select("dialogue_id", "annotator_id", F.explode("dims").alias("e")).select("dialogue_id", "annotator_id", F.col("e.key").alias("dimension"), F.col("e.value").alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))


@_query(f"""WITH {_SCORES}, M AS (SELECT *, avg(score) OVER (PARTITION BY dialogue_id, dimension) AS m, count(*) OVER (PARTITION BY dialogue_id, dimension) AS k FROM X)
    SELECT dialogue_id, dimension, count(*) AS n, round(avg(CASE WHEN abs(score - m) <= 1.0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS agreement, round(stddev_pop(score), 6) AS std FROM M WHERE k >= 2 GROUP BY 1, 2""", ctes=False)
def a28_annotator_agreement(spark, d):
    w = Window.partitionBy("dialogue_id", "dimension")
    m = _scores(spark, d).withColumn("m", F.avg("score").over(w)).withColumn("k", F.count("*").over(w)).where("k >= 2")
    return m.groupBy("dialogue_id", "dimension").agg(F.count("*").alias("n"), _r(F.avg(F.when(F.abs(F.col("score") - F.col("m")) <= 1.0, 1.0).otherwise(0.0)), "agreement"), _r(F.stddev_pop("score"), "std"))


@_query(f"WITH {_SCORES} SELECT dimension, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max FROM X GROUP BY 1", ctes=False)
def a29_human_statistics(spark, d):
    return _scores(spark, d).groupBy("dimension").agg(F.count("*").alias("n"), _r(F.avg("score"), "mean"), _r(F.stddev_pop("score"), "std"), F.min("score").alias("min"), F.max("score").alias("max"))


@_query(f"""SELECT domain, goal, CAST(k AS INTEGER) AS k FROM (SELECT domain, goal, row_number() OVER (PARTITION BY domain ORDER BY first, goal) AS k FROM
    (SELECT {_DOMAIN} AS domain, {_clean('goal')} AS goal, min(rec_id) AS first FROM dialogues WHERE goal IS NOT NULL GROUP BY 1, 2) WHERE goal <> '') WHERE k <= 100""", ctes=False)
def a35_seed_goals(spark, d):
    return reports.seed_goals(_d(spark, d).select("rec_id", "domain", X.clean(F.col("goal")).alias("goal")), 100)


@_query(""", S AS (SELECT *, row_number() OVER (ORDER BY score DESC, rec_id) AS k, count(*) OVER () AS n FROM D WHERE score > 0) SELECT rec_id, score FROM S WHERE k <= greatest(1, CAST(floor(n * 0.1) AS BIGINT))""")
def t1_top_share(spark, d):
    return reports.best_share(_d(spark, d).where("score > 0").select("rec_id", "score"), 0.1)


@_query(""", A AS (SELECT *, count(*) OVER () AS acc, row_number() OVER (ORDER BY score, rec_id) AS k FROM D WHERE score >= 0.5), N AS (SELECT count(*) AS total FROM D)
    SELECT rec_id FROM A, N WHERE k <= CAST(floor(acc * (0.5 - least(0.5, (total - acc) / CAST(total AS DOUBLE)))) AS BIGINT)""")
def v12_discard_to_rate(spark, d):
    return reports.discard(_d(spark, d).select("rec_id", "score"), F.col("score") >= 0.5, 0.5)


@_query("""SELECT rec_id, CAST(i AS INTEGER) AS turn_id, role, text FROM T WHERE role <> 'System' QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY i DESC) <= 6""")
def w3_last_six_turns(spark, d):
    numbered = F.transform("turns", lambda t, i: F.struct((i + 1).alias("turn_id"), t["role"].alias("role"), t["text"].alias("text")))
    kept = F.filter(numbered, lambda t: t["role"] != "System")
    last = F.slice(kept, F.greatest(F.size(kept) - 5, F.lit(1)), F.lit(6))
    return _d(spark, d).select("rec_id", F.inline(last))


@_query("SELECT rec_id, arg_max(text, i) FILTER (role = 'User') AS last_user, arg_max(text, i) FILTER (role = 'SupportBot') AS last_support FROM T GROUP BY 1")
def w5_last_by_role(spark, d):
    last = lambda role: F.get(F.reverse(D.texts(role)), F.lit(0))
    return _d(spark, d).where(F.size("turns") > 0).select("rec_id", last("User").alias("last_user"), last("SupportBot").alias("last_support"))


@_query(f""", L AS (SELECT rec_id, goal, i, {_pieces('text')} AS a, lag({_pieces('text')}) OVER (PARTITION BY rec_id ORDER BY i) AS b, n FROM T WHERE i > n - 4),
    R AS (SELECT rec_id, any_value({_pieces('goal')}) AS g, list_distinct(flatten(list(a))) AS w, avg({_jaccard('a', 'b')}) FILTER (b IS NOT NULL) AS s, count(*) AS k FROM L GROUP BY 1)
    SELECT D.rec_id, round(CASE WHEN coalesce(k, 0) < 2 THEN 0 ELSE 0.6 * len(list_intersect(g, w)) / CAST(greatest(len(g), 1) AS DOUBLE) + 0.4 * s END, 6)::DOUBLE AS reward FROM D LEFT JOIN R USING (rec_id)""")
def w9_step_reward(spark, d):
    return _d(spark, d).select("rec_id", _r(D.step_reward(), "reward"))


@_query("""SELECT rec_id, count(*) AS n_kept FROM (SELECT rec_id, role, text, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM T WINDOW w AS (PARTITION BY rec_id ORDER BY i)) WHERE pr IS NULL OR pr <> role OR pt <> text GROUP BY 1""")
def w10_without_consecutive_repeats(spark, d):
    return _d(spark, d).where(F.size("turns") > 0).select("rec_id", F.size(D.without_runs()).cast("long").alias("n_kept"))


@_query("SELECT rec_id, domain, CAST(i AS INTEGER) AS turn_id, role, text FROM T")
def w11_turn_rows(spark, d):
    return D.turn_rows(_d(spark, d))


@_query(rf"""SELECT rec_id, {_clean('goal')} AS cleaned, CASE WHEN length(goal) > 40 THEN left(goal, 37) || '...' ELSE goal END AS shortened, left(md5(goal), 8) AS goal_hash, left(regexp_replace(goal, '[^\w\-]+', '_', 'g'), 120) AS slug,
    CASE {' '.join(f"WHEN {_any('lower(goal)', ws)} THEN '{k}'" for k, ws in D.DOMAIN_WORDS.items())} ELSE 'general' END AS named_domain FROM D""")
def s_goal_texts(spark, d):
    g = F.col("goal")
    return _d(spark, d).select("rec_id", X.clean(g).alias("cleaned"), X.truncate(g, 40).alias("shortened"), F.left(F.md5(g), F.lit(8)).alias("goal_hash"), X.slug(g).alias("slug"), D.domain_of_goal(g).alias("named_domain"))


@_query("SELECT rec_id, string_agg(role || ': ' || text, chr(10) ORDER BY i) AS transcript FROM T GROUP BY 1")
def pr5_transcripts(spark, d):
    return _d(spark, d).where(F.size("turns") > 0).select("rec_id", D.transcript().alias("transcript"))


@_query(r"""SELECT D.rec_id, 'story ' || replace(coalesce(dialogue_id, ''), ' ', '_') || coalesce(chr(10) || s, '') AS story FROM D LEFT JOIN
    (SELECT rec_id, string_agg(CASE WHEN lower(role) = 'user' THEN '- user: "' ELSE '- bot: "' END || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), ' ') || '"', chr(10) ORDER BY i) AS s
     FROM T WHERE """ + _strip("text") + r""" <> '' GROUP BY 1) USING (rec_id)""")
def sk7_story_export(spark, d):
    return _d(spark, d).select("rec_id", D.story(F.coalesce("dialogue_id", F.lit(""))).alias("story"))


@_query("""SELECT rec_id, CAST(i AS INTEGER) AS turn_id, CASE WHEN role = 'User' THEN 'user' ELSE 'assistant' END AS speaker, coalesce(score > 0.7, false) AS task_success, round(5 * coalesce(score, 0), 6) AS judge_score FROM T""")
def pr9_display_projection(spark, d):
    rows = F.transform("turns", lambda t, i: F.struct((i + 1).alias("turn_id"), F.when(t["role"] == "User", "user").otherwise("assistant").alias("speaker")))
    return _d(spark, d).select("rec_id", F.coalesce(F.col("score") > 0.7, F.lit(False)).alias("task_success"), F.round(5 * F.coalesce("score", F.lit(0.0)), 6).alias("judge_score"), F.inline(rows))


@_query(f""", G AS (SELECT {_DOMAIN} AS domain, {_clean('goal')} AS goal FROM seed_goals), H AS (SELECT DISTINCT domain, {_clean('goal')} AS goal FROM D WHERE {_clean('goal')} <> '')
    SELECT domain, count(*) AS added FROM (SELECT * FROM H EXCEPT SELECT * FROM G) GROUP BY 1""")
def j14_goals_to_add(spark, d):
    mine = _d(spark, d).select("domain", X.clean(F.col("goal")).alias("goal")).where("goal <> ''").distinct()
    held = table(spark, d, "seed_goals").select(F.lower(D.strip(F.col("domain"))).alias("domain"), X.clean(F.col("goal")).alias("goal"))
    return mine.join(held, ["domain", "goal"], "left_anti").groupBy("domain").agg(F.count("*").alias("added"))


@_query(f"""SELECT a.annotation_id, a.dialogue_id, d.dialogue_id IS NOT NULL AS known, coalesce(len(list_filter(map_values(a.dimensions), lambda v: v IS NULL OR isnan(v) OR v < 1 OR v > 5)) = 0, false) AS in_range
    FROM annotations a LEFT JOIN (SELECT DISTINCT dialogue_id FROM dialogues WHERE dialogue_id IS NOT NULL) d USING (dialogue_id)""", ctes=False)
def v35_annotation_validity(spark, d):
    known = table(spark, d, "dialogues").select("dialogue_id").where("dialogue_id IS NOT NULL").distinct().withColumn("known", F.lit(True))
    fine = F.forall(F.map_values("dimensions"), lambda v: v.isNotNull() & ~F.isnan(v) & v.between(1, 5))
    return table(spark, d, "annotations").join(known, "dialogue_id", "left").select("annotation_id", "dialogue_id", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce(fine, F.lit(False)).alias("in_range"))


@_query(""", V AS (SELECT version_id, count(*) AS n, avg(len(turns)) AS t, avg(score) AS s FROM D GROUP BY 1), B AS (SELECT min(version_id) AS a, max(version_id) AS b FROM V)
    SELECT x.version_id AS old_version, y.version_id AS new_version, y.n - x.n AS d_count, round(y.t - x.t, 6) AS d_turns, round(y.s - x.s, 6) AS d_score FROM B JOIN V x ON x.version_id = a JOIN V y ON y.version_id = b""")
def j7_version_comparison(spark, d):
    return reports.compare_first_and_last(_d(spark, d))


_TERMS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: true)"


@_query(f""", R AS (SELECT {_DOMAIN} AS domain, pos, goal FROM seed_goals), RT AS (SELECT domain, pos, unnest({_TERMS.format('goal')}) AS term FROM R), RF AS (SELECT domain, pos, term, count(*) AS tf FROM RT GROUP BY ALL),
    N AS (SELECT domain, count(DISTINCT pos) AS n FROM R GROUP BY 1), F0 AS (SELECT domain, term, count(*) AS df FROM RF GROUP BY 1, 2), I AS (SELECT domain, term, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM F0 JOIN N USING (domain) WHERE df <= 0.95 * n),
    RW AS (SELECT domain, pos, term, tf * idf AS w FROM RF JOIN I USING (domain, term)), RN AS (SELECT domain, pos, sqrt(sum(w * w)) AS norm FROM RW GROUP BY 1, 2),
    Q AS (SELECT DISTINCT domain, goal FROM D WHERE goal <> ''), QT AS (SELECT domain, goal, unnest({_TERMS.format('goal')}) AS term FROM Q), QF AS (SELECT domain, goal, term, count(*) AS tf FROM QT GROUP BY ALL),
    QW AS (SELECT domain, goal, term, tf * idf AS w FROM QF JOIN I USING (domain, term)), QN AS (SELECT domain, goal, sqrt(sum(w * w)) AS norm FROM QW GROUP BY 1, 2),
    DOT AS (SELECT q.domain, q.goal, r.pos, sum(q.w * r.w) AS dot FROM QW q JOIN RW r USING (domain, term) GROUP BY 1, 2, 3),
    SIM AS (SELECT DOT.domain, DOT.goal, DOT.pos, round(dot / (QN.norm * RN.norm), 6) AS sim FROM DOT JOIN QN USING (domain, goal) JOIN RN ON RN.domain = DOT.domain AND RN.pos = DOT.pos)
    SELECT domain, goal, pos, sim FROM SIM QUALIFY row_number() OVER (PARTITION BY domain, goal ORDER BY sim DESC, pos) = 1""")
def j4_nearest_seed_goal(spark, d):
    refs = table(spark, d, "seed_goals").select(F.lower(D.strip(F.col("domain"))).alias("domain"), "pos", "goal")
    return nearest.nearest_by_tfidf(_d(spark, d).where("goal <> ''").select("domain", "goal").distinct(), refs)


_TOKENS = r"list_filter(regexp_split_to_array(lower(goal), '\s+'), lambda w: w <> '')"
_GRAMS = lambda rows, keys: f"SELECT {keys}, n, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS c FROM (SELECT {keys}, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {rows}, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL"
_BLEU = f""", Q AS (SELECT domain, goal, {_TOKENS} AS w FROM (SELECT DISTINCT domain, goal FROM D WHERE goal <> '')), R AS (SELECT {_DOMAIN} AS domain, pos, {_TOKENS} AS w FROM seed_goals),
    QG AS ({_GRAMS('Q', 'domain, goal')}), RG AS ({_GRAMS('R', 'domain, pos')}), HIT AS (SELECT QG.domain, goal, pos, n, sum(least(QG.c, RG.c)) AS hit FROM QG JOIN RG USING (domain, n, gram) GROUP BY ALL),
    PAIR AS (SELECT Q.domain, goal, pos, n, len(Q.w) AS lq, len(R.w) AS lr FROM Q JOIN R USING (domain), (SELECT unnest([1, 2, 3, 4]) AS n)),
    EACH AS (SELECT PAIR.domain, PAIR.goal, PAIR.pos, lq, lr, sum(ln(coalesce(hit, 0.1) / greatest(1, lq - n + 1)) / 4) AS logs, max(CASE WHEN n = 1 THEN coalesce(hit, 0) ELSE 0 END) AS common FROM PAIR LEFT JOIN HIT USING (domain, goal, pos, n) GROUP BY ALL),
    BEST AS (SELECT domain, goal, round(max(CASE WHEN common = 0 OR lq = 0 OR lr = 0 THEN 0 ELSE exp(logs) * CASE WHEN lq > lr THEN 1 ELSE exp(1 - lr / CAST(lq AS DOUBLE)) END END), 6) AS bleu FROM EACH GROUP BY 1, 2)"""


def _bleus(spark, d) -> DataFrame:
    refs = table(spark, d, "seed_goals").select(F.lower(D.strip(F.col("domain"))).alias("domain"), "pos", "goal")
    return nearest.best_bleu(_d(spark, d).where("goal <> ''").select("domain", "goal").distinct(), refs)


@_query(f"{_BLEU} SELECT * FROM BEST")
def j3_best_bleu(spark, d):
    return _bleus(spark, d)


@_query(f"{_BLEU} SELECT coalesce(domain, '{_ALL}') AS domain, count(*) AS n, round(avg(bleu), 5) AS mean, round(stddev_pop(bleu), 5) AS std FROM BEST GROUP BY ROLLUP (domain)")
def a5_bleu_summary(spark, d):
    return _by_domain(_bleus(spark, d), F.count("*").alias("n"), F.round(F.avg("bleu"), 5).alias("mean"), F.round(F.stddev_pop("bleu"), 5).alias("std"))


@_query("""SELECT feed, count(*) AS n_lines, count(*) FILTER (CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' ELSE false END) AS n_sound, count(DISTINCT file_name) AS n_files FROM snapshot_records GROUP BY 1""", ctes=False)
def sc4_json_lines(spark, d):
    return reports.sound_lines(table(spark, d, "snapshot_records"))


_FACTS = lambda name: f"""(SELECT rec_id, list(f ORDER BY o)[1:12] AS {name} FROM (SELECT rec_id, f, min(i * 100000 + k) AS o FROM (SELECT rec_id, i, unnest(m.{name}) AS f, generate_subscripts(m.{name}, 1) AS k FROM SN)
    WHERE f IS NOT NULL AND NOT regexp_matches(f, '^ *$') GROUP BY 1, 2) GROUP BY 1)"""  # noqa: E731


@_query(f"""WITH SN AS (SELECT rec_id, generate_subscripts(pipeline_turns, 1) AS i, unnest(pipeline_turns).memory_snapshot AS m FROM dialogues),
    SL0 AS (SELECT rec_id, i, m.slots AS s, unnest(map_keys(m.slots)) AS dom FROM SN), SL1 AS (SELECT rec_id, i, dom, s[dom] AS v, unnest(map_keys(s[dom])) AS slot FROM SL0),
    SL AS (SELECT rec_id, dom, slot, arg_max(v[slot], i) FILTER (v[slot] IS NOT NULL) AS x FROM SL1 GROUP BY ALL),
    JS AS (SELECT rec_id, count(*) AS n, '[' || string_agg('{{"domain":' || to_json(dom) || ',"slot":' || to_json(slot) || CASE WHEN x IS NULL THEN '' ELSE ',"value":' || to_json(x) END || '}}', ',' ORDER BY dom, slot) || ']' AS j FROM SL GROUP BY 1)
    SELECT d.rec_id, coalesce(user_facts, []) AS user_facts, coalesce(support_facts, []) AS support_facts, CAST(coalesce(n, 0) AS INTEGER) AS n_slots, coalesce(j, '[]') AS slots
    FROM dialogues d LEFT JOIN {_FACTS('user_facts')} USING (rec_id) LEFT JOIN {_FACTS('support_facts')} USING (rec_id) LEFT JOIN JS USING (rec_id) WHERE len(pipeline_turns) > 0""", ctes=False)
def st3_memory_fold(spark, d):
    return memory.fold(table(spark, d, "dialogues"))


@_query(f"SELECT domain, count(*) AS n_dialogues, sum(len(turns))::BIGINT AS n_turns, round(avg(score), 6) AS mean_score, count(*) FILTER (score > 0.7) AS n_good FROM D GROUP BY 1")
def a37_dashboard_totals(spark, d):
    return _d(spark, d).groupBy("domain").agg(F.count("*").alias("n_dialogues"), F.sum(F.size("turns")).alias("n_turns"), _r(F.avg("score"), "mean_score"), F.count_if(F.col("score") > 0.7).alias("n_good"))


@_query("""SELECT coalesce(metadata.llm_provider, 'unknown') AS provider, count(*) AS n, round(avg(metadata.generation_time_seconds), 6) AS mean_seconds, round(max(metadata.generation_time_seconds), 6) AS max_seconds,
    count(*) FILTER (metadata.stop_reason = 'goal_reached') AS reached FROM dialogues GROUP BY 1""", ctes=False)
def a32_generation_totals(spark, d):
    m = table(spark, d, "dialogues").select("metadata.*")
    return m.groupBy(F.coalesce("llm_provider", F.lit("unknown")).alias("provider")).agg(F.count("*").alias("n"), _r(F.avg("generation_time_seconds"), "mean_seconds"), _r(F.max("generation_time_seconds"), "max_seconds"), F.count_if(F.col("stop_reason") == "goal_reached").alias("reached"))


# windows that the watermark, two hours behind the newest event, has closed
@_query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
    WHERE time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 2 hour GROUP BY 1, 2""", ctes=False)
def st_windowed_events(spark, d):
    from turnloom.streaming.memory_stream import as_stream, drained, windowed_events

    return drained(windowed_events(as_stream(spark, d, "events"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_query(f""", {_BODYWORDS}, C AS (SELECT rec_id, avg({_jaccard('a', 'b')}) AS c FROM P WHERE la > 0 AND lb > 0 GROUP BY 1),
    A AS (SELECT coalesce(r.metadata.model_version, 'unknown') AS arm, G2.d1, coalesce(C.c, 0) AS c FROM dialogues r LEFT JOIN G2 USING (rec_id) LEFT JOIN C USING (rec_id))
    SELECT arm, count(*) AS n, round(avg(d1), 6) AS distinct_1, round(avg(c), 6) AS coherence FROM A GROUP BY 1""")
def a24_arm_metrics(spark, d):
    d1 = F.when(F.size(X.words(D.whole())) > 0, X.once(X.words(D.whole()), X.distinct_share))
    rows = _d(spark, d).select(F.col("model").alias("arm"), d1.alias("d1"), D.coherence().alias("c"))
    return rows.groupBy("arm").agg(F.count("*").alias("n"), _r(F.avg("d1"), "distinct_1"), _r(F.avg("c"), "coherence"))


@_query(f"""SELECT domain, goal FROM (SELECT {_DOMAIN} AS domain, goal FROM seed_goals WHERE goal IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY md5(goal), goal) = 1""", ctes=False)
def t8_sampled_goal(spark, d):
    goals = table(spark, d, "seed_goals").where("goal IS NOT NULL").select(F.lower(D.strip(F.col("domain"))).alias("domain"), "goal")
    return goals.groupBy("domain").agg(F.min_by("goal", F.struct(F.md5("goal"), F.col("goal"))).alias("goal"))


@_query("SELECT version_id, count(*) AS n, max(ingested_at) AS newest FROM dialogues GROUP BY 1 ORDER BY version_id DESC LIMIT 10", ctes=False)
def t5_newest_versions(spark, d):
    v = table(spark, d, "dialogues").groupBy("version_id").agg(F.count("*").alias("n"), F.max("ingested_at").alias("newest"))
    return v.orderBy(F.desc("version_id")).limit(10)


@_query("""SELECT rec_id, CAST(list_sum(map_values(pipeline_turns[len(pipeline_turns)].timings_ms)) AS DOUBLE) IS NOT NULL AS timed, CAST(len(pipeline_turns) AS INTEGER) AS n_pairs,
    len(list_filter(pipeline_turns, lambda p: p.reflection_score IS NOT NULL)) AS n_reflected FROM dialogues WHERE len(pipeline_turns) > 0""", ctes=False)
def pr23_reflection_slices(spark, d):
    last = F.get("pipeline_turns", F.size("pipeline_turns") - 1)["timings_ms"]
    rows = table(spark, d, "dialogues").where(F.size("pipeline_turns") > 0)
    return rows.select("rec_id", F.coalesce(F.exists(F.map_values(last), lambda v: v.isNotNull()), F.lit(False)).alias("timed"), F.size("pipeline_turns").alias("n_pairs"), F.size(F.filter("pipeline_turns", lambda p: p["reflection_score"].isNotNull())).cast("long").alias("n_reflected"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
