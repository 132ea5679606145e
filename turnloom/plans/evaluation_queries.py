"""Queries of judging, reports, selections and projections, with SQL that has its own literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import model_output as O
from turnloom.functions import stats as S
from turnloom.functions import text as X
from turnloom.operators import dialogues as D
from turnloom.operators import judging as J
from turnloom.operators import memory
from turnloom.plans.dialogue_queries import _ALL, _BODYWORDS, _CTE, _DOMAIN, _by_domain, _clean, _d, _distinct, _jaccard, _r, _scores, _strip
from turnloom.plans.dialogue_queries import _SCORES as _SCORE_ROWS
from turnloom.plans.dialogue_queries import oracle_sql as _dialogue_sql
from turnloom.plans.dialogue_queries import pr9_display_projection
from turnloom.sources.tables import table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, ctes: bool = True):
    def wrap(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = f"WITH {_CTE} {sql}" if ctes else sql
        return f

    return wrap


_MARKS = f"""{_SCORE_ROWS}, BYD AS (SELECT dialogue_id, avg(score) FILTER (dimension = 'coherence') AS coherence, avg(score) FILTER (dimension = 'overall') AS mark, avg(score) FILTER (dimension = 'goal_relevance') >= 3 AS relevant FROM X GROUP BY 1),
    MK AS (SELECT d.rec_id, BYD.* EXCLUDE (dialogue_id) FROM dialogues d JOIN BYD USING (dialogue_id))"""


def _marks(spark, d) -> DataFrame:
    """Mean marks of each record's dialogue over its annotations."""
    of = lambda name: F.avg(F.when(F.col("dimension") == name, F.col("score")))
    by = _scores(spark, d).groupBy("dialogue_id").agg(of("coherence").alias("coherence"), of("overall").alias("overall"), (of("goal_relevance") >= 3).alias("relevant"))
    return table(spark, d, "dialogues").select("rec_id", "dialogue_id").join(by, "dialogue_id").drop("dialogue_id")


_ASSESSED = f""", {_MARKS}, H AS ({_dialogue_sql()['v9_heuristic_checks']}),
    AS1 AS (SELECT H.rec_id, D.domain, round(least(1, greatest(0, 0.3 * heuristic + 0.3 * coalesce(coherence, 0) / 5 + 0.4 * coalesce(mark, 0) / 5)), 6)::DOUBLE AS overall,
        CASE WHEN mark IS NULL THEN heuristic >= 0.5 ELSE heuristic >= 0.5 OR (coalesce(coherence, 0) >= 3 AND mark >= 3 AND coalesce(relevant, false)) END AS passed,
        array_to_string(list_filter([CASE WHEN NOT length_ok THEN 'length' END, CASE WHEN NOT repetition_ok THEN 'repetition' END, CASE WHEN NOT language_ok THEN 'profanity' END, CASE WHEN NOT roles_ok THEN 'roles' END,
            CASE WHEN NOT goal_ok THEN 'goal' END, CASE WHEN NOT answers_ok THEN 'answers' END], lambda x: x IS NOT NULL), '; ') AS issues
        FROM H JOIN D USING (rec_id) LEFT JOIN MK USING (rec_id))"""


def _assessed(spark, d) -> DataFrame:
    return J.assessed(D.checks(_d(spark, d)), _marks(spark, d))


@_query(f"{_ASSESSED} SELECT rec_id, overall, passed, issues FROM AS1")
def v10_quality_decisions(spark, d):
    return _assessed(spark, d).drop("domain")


@_query(f"{_ASSESSED} SELECT domain, count(*) FILTER (passed) AS accepted, count(*) FILTER (NOT passed) AS rejected, round(count(*) FILTER (passed) / CAST(count(*) AS DOUBLE), 6) AS acceptance_rate FROM AS1 GROUP BY 1")
def o7_accepted_and_rejected(spark, d):
    return _assessed(spark, d).groupBy("domain").agg(F.count_if("passed").alias("accepted"), F.count_if(~F.col("passed")).alias("rejected"), _r(F.count_if("passed") / F.count("*"), "acceptance_rate"))


@_query("""SELECT D.rec_id, len(turns) >= 2 AND EXISTS (SELECT 1 FROM T WHERE T.rec_id = D.rec_id AND i > n - 6 AND role = 'User' AND regexp_matches(lower(text), 'thank you|thanks|perfect|great|excellent|that works|sounds good|all set|that''ll work|appreciate it|good, thank'))
    AND EXISTS (SELECT 1 FROM T WHERE T.rec_id = D.rec_id AND i > n - 6 AND role = 'SupportBot' AND regexp_matches(lower(text), 'booked|confirmed|reserv(ed|ation)|reference|pickup at|at |pm|am|from |to |venue|restaurant|hotel|taxi|booking|confirmation|address|phone number|time is|scheduled')) AS satisfied FROM D""")
def v15_closing_evidence(spark, d):
    return _d(spark, d).select("rec_id", J.closing_evidence().alias("satisfied"))


@_query(f"""SELECT domain, count(*) AS n_plans, count(*) FILTER (contains(lower(plan), 'check') AND contains(lower(plan), 'availability')) AS checking, count(*) FILTER (contains(lower(plan), 'near') AND contains(lower(plan), 'complete')) AS near_complete
    FROM (SELECT {_DOMAIN} AS domain, unnest(turns).metadata.plan AS plan FROM dialogues) WHERE plan IS NOT NULL GROUP BY 1""", ctes=False)
def v34_plans_near_complete(spark, d):
    rows = table(spark, d, "dialogues")
    name = F.lower(D.strip(F.col("domain")))
    plans = rows.select(F.when(name.isNull() | (name == ""), "unknown").otherwise(name).alias("domain"), F.explode(F.transform("turns", lambda t: t["metadata"]["plan"])).alias("plan")).where("plan IS NOT NULL")
    low = F.lower("plan")
    return plans.groupBy("domain").agg(F.count("*").alias("n_plans"), F.count_if(low.contains("check") & low.contains("availability")).alias("checking"), F.count_if(J.near_complete(F.col("plan"), F.col("plan"))).alias("near_complete"))


@_query(f"""SELECT annotator_id, count(*) AS n, count(*) FILTER (task_completed) AS completed, count(DISTINCT dialogue_id) AS n_dialogues FROM annotations WHERE list_has_any(coalesce(issues, []), ['rude', 'repetition']) GROUP BY 1""", ctes=False)
def v36_filtered_annotations(spark, d):
    kept = table(spark, d, "annotations").where(F.arrays_overlap("issues", F.array(F.lit("rude"), F.lit("repetition"))))
    return kept.groupBy("annotator_id").agg(F.count("*").alias("n"), F.count_if("task_completed").alias("completed"), F.countDistinct("dialogue_id").alias("n_dialogues"))


@_query(f"""SELECT {_DOMAIN} AS requested, {_DOMAIN} IN ('hotel', 'restaurant', 'taxi', 'train', 'attraction') AS valid FROM keep_targets""", ctes=False)
def v37_requested_domains(spark, d):
    name = F.lower(D.strip(F.col("domain")))
    valid = F.size(F.array_except(F.array("requested"), F.array(*map(F.lit, D.DOMAIN_WORDS)))) == 0
    return table(spark, d, "keep_targets").select(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")).alias("requested")).withColumn("valid", valid)


@_query(f"""WITH {_SCORE_ROWS}, DD AS (SELECT dialogue_id, min({_DOMAIN}) AS domain FROM dialogues WHERE dialogue_id IS NOT NULL GROUP BY 1)
    SELECT coalesce(domain, '{_ALL}') AS domain, dimension, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM X JOIN DD USING (dialogue_id) GROUP BY GROUPING SETS ((domain, dimension), (dimension))""", ctes=False)
def a13_judge_summary(spark, d):
    name = F.lower(D.strip(F.col("domain")))
    of = table(spark, d, "dialogues").where("dialogue_id IS NOT NULL").groupBy("dialogue_id").agg(F.min(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))).alias("domain"))
    out = _scores(spark, d).join(of, "dialogue_id").groupingSets([["domain", "dimension"], ["dimension"]], "domain", "dimension").agg(F.count("*").alias("n"), _r(F.avg("score"), "mean"), _r(F.stddev_pop("score"), "std"))
    return out.withColumn("domain", F.coalesce("domain", F.lit(_ALL)))


@_query(r""", B AS (SELECT D.*, coalesce(body, '') AS body FROM D LEFT JOIN W USING (rec_id)), K AS (SELECT rec_id, domain, body, len(turns) AS n, list_filter(regexp_split_to_array(lower(goal), '\s+'), lambda w: regexp_matches(w, '^\d+$') OR w IN ('morning', 'evening', 'tonight', 'today', 'tomorrow')) AS w FROM B)
    SELECT domain, CAST(sum(len(list_filter(w, lambda x: contains(body, x)))) AS BIGINT) AS slot_hits, CAST(sum(len(w)) AS BIGINT) AS slots, count(*) FILTER (n > 0) AS n_dialogues,
        count(*) FILTER (n > 0 AND NOT regexp_matches(body, 'i thought you said|you already told me|that contradicts|earlier you said')) AS consistent FROM K GROUP BY 1""")
def a14_slots_and_state(spark, d):
    rows = _d(spark, d).withColumn("w", J.slot_tokens())
    talked = F.size("turns") > 0
    return rows.groupBy("domain").agg(
        F.sum(F.size(F.filter("w", lambda x: F.col("body").contains(x)))).alias("slot_hits"), F.sum(F.size("w")).alias("slots"), F.count_if(talked).alias("n_dialogues"),
        F.count_if(talked & ~X.holds_any(D.whole(), D.CONTRADICTION)).alias("consistent"))


_REPORT = f""", {_BODYWORDS}, C AS (SELECT rec_id, avg({_jaccard('a', 'b')}) AS c FROM P WHERE la > 0 AND lb > 0 GROUP BY 1),
    M AS (SELECT 'distinct_1' AS metric, d1 AS x FROM G2 UNION ALL SELECT 'distinct_2', d2 FROM G2 UNION ALL SELECT 'coherence', coalesce(c, 0) FROM D LEFT JOIN C USING (rec_id)
        UNION ALL SELECT 'n_turns', CAST(len(turns) AS DOUBLE) FROM D UNION ALL SELECT 'completed', CAST(completed AS DOUBLE) FROM ({_dialogue_sql()['v19_goal_completion']}))
    SELECT metric, count(x) AS n, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, round(avg(x) - 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(x)), 6) AS low, round(avg(x) + 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(x)), 6) AS high FROM M GROUP BY 1"""
_METRICS = ["distinct_1", "distinct_2", "coherence", "n_turns", "completed"]


def _metrics(spark, d) -> DataFrame:
    w = F.when(F.size(X.words(D.whole())) > 0, X.words(D.whole()))
    share = lambda items: X.once(items, lambda v: F.when(v.isNotNull(), X.distinct_share(v)))
    return _d(spark, d).select("rec_id", share(w).alias("distinct_1"), X.once(w, lambda v: F.when(v.isNotNull(), X.distinct_share(X.bigrams(v)))).alias("distinct_2"), D.coherence().alias("coherence"), F.size("turns").cast("double").alias("n_turns"), D.goal_completion().cast("double").alias("completed"))


def _rounded(report: DataFrame) -> DataFrame:
    return report.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")])


@_query(_REPORT)
def a19_research_report(spark, d):
    return _rounded(J.merged_report(J.partials(_metrics(spark, d), _METRICS, [])))


@_query(_REPORT)
def a20_merged_chunks(spark, d):
    return _rounded(J.merged_report(J.partials(_metrics(spark, d), _METRICS, [F.pmod(F.xxhash64("rec_id"), F.lit(16)).alias("chunk")])))


@_query("""SELECT rec_id, CAST(coalesce(len(s.unresolved_goals), 0) + coalesce(list_sum(list_transform(map_values(s.slots), lambda v: coalesce(cardinality(v), 0))), 0) AS INTEGER) AS complexity
    FROM (SELECT rec_id, pipeline_turns[len(pipeline_turns)].memory_snapshot AS s FROM dialogues WHERE len(pipeline_turns) > 0)""", ctes=False)
def a30_goal_complexity(spark, d):
    s = F.get("pipeline_turns", F.size("pipeline_turns") - 1)["memory_snapshot"]
    n_slots = F.aggregate(F.transform(F.map_values(s["slots"]), lambda v: F.coalesce(F.size(v), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return table(spark, d, "dialogues").where(F.size("pipeline_turns") > 0).select("rec_id", (F.coalesce(F.size(s["unresolved_goals"]), F.lit(0)) + F.coalesce(n_slots, F.lit(0))).alias("complexity"))


@_query(r"""SELECT rec_id, round(avg(CAST(regexp_extract(p.reflection_score, 'score=(\d+)', 1) AS DOUBLE)), 4) AS mean_reward, count(*) AS n_scored FROM (SELECT rec_id, unnest(pipeline_turns) AS p FROM dialogues) WHERE regexp_matches(p.reflection_score, 'score=\d') GROUP BY 1""", ctes=False)
def a31_trajectory_means(spark, d):
    scores = F.filter(F.transform("pipeline_turns", lambda p: F.nullif(F.regexp_extract(p["reflection_score"], r"score=(\d+)", 1), F.lit("")).cast("double")), lambda x: x.isNotNull())
    rows = table(spark, d, "dialogues").select("rec_id", scores.alias("s")).where(F.size("s") > 0)
    return rows.select("rec_id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s"), 4).alias("mean_reward"), F.size("s").cast("long").alias("n_scored"))


@_query(f"""SELECT domain, 20 + (k <= 1003 - 125 * 8)::INT + 105 AS n FROM (SELECT domain, row_number() OVER (ORDER BY domain) AS k FROM (SELECT DISTINCT {_DOMAIN} AS domain FROM keep_targets))""", ctes=False)
def a33_even_allocation(spark, d):
    names = sorted(r[0] for r in table(spark, d, "keep_targets").select(F.coalesce(F.nullif(F.lower(D.strip(F.col("domain"))), F.lit("")), F.lit("unknown"))).distinct().collect())  # a fixed list of sources
    return spark.createDataFrame(list(S.shares_of(1003, names).items()), "domain string, n int")


_LAST = "SELECT domain, min(dialogue_id) AS dialogue_id FROM dialogues WHERE domain = 'hotel' AND dialogue_id IS NOT NULL GROUP BY 1"


@_query(f"""SELECT dialogue_id, domain, goal FROM (SELECT dialogue_id, domain, goal, rec_id FROM dialogues JOIN ({_LAST}) USING (domain, dialogue_id) ORDER BY rec_id LIMIT 1)""", ctes=False)
def sc3_point_lookup(spark, d):
    store = table(spark, d, "dialogues").select("dialogue_id", "domain", "goal")
    wanted = store.where("domain = 'hotel'").agg(F.min("dialogue_id")).first()[0]
    return J.lookup(store, "hotel", wanted)


@_query("""SELECT rec_id, metadata.generated_at AS generated_at FROM dialogues ORDER BY coalesce(metadata.generated_at, '') DESC, rec_id DESC LIMIT 100""", ctes=False)
def sc16_latest_for_evaluation(spark, d):
    rows = table(spark, d, "dialogues").select("rec_id", F.col("metadata.generated_at").alias("generated_at"))
    return J.newest(rows, F.col("generated_at"), 100)


_HUB = f""", S AS (SELECT *, row_number() OVER (ORDER BY score DESC, rec_id) AS k, count(*) OVER () AS n FROM D WHERE score > 0), B AS (SELECT domain, dialogue_id, score, false AS seeded FROM S WHERE k <= greatest(1, CAST(floor(n * 0.1) AS BIGINT))),
    SD AS (SELECT {_DOMAIN} AS domain, {_DOMAIN} || '_seed_' || lpad(CAST(pos AS VARCHAR), 4, '0') AS dialogue_id FROM seed_goals),
    HUB AS (SELECT * FROM B UNION ALL SELECT domain, dialogue_id, NULL, true FROM (SELECT * FROM SD WHERE domain NOT IN (SELECT domain FROM B GROUP BY 1 HAVING count(*) >= 5) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY dialogue_id) <= 5))"""


def _hub(spark, d) -> DataFrame:
    name = F.coalesce(F.nullif(F.lower(D.strip(F.col("domain"))), F.lit("")), F.lit("unknown"))
    seeds = table(spark, d, "seed_goals").select(name.alias("domain"), F.concat(name, F.lit("_seed_"), F.lpad(F.col("pos").cast("string"), 4, "0")).alias("dialogue_id"))
    return J.few_shot_hub(_d(spark, d), seeds, 0.1)


@_query(f"{_HUB} SELECT domain, count(*) FILTER (NOT seeded) AS n_best, count(*) FILTER (seeded) AS n_seeds FROM HUB GROUP BY 1")
def t2_seeded_hub(spark, d):
    return _hub(spark, d).groupBy("domain").agg(F.count_if(~F.col("seeded")).alias("n_best"), F.count_if("seeded").alias("n_seeds"))


@_query(f"{_HUB} SELECT domain, dialogue_id, seeded FROM (SELECT DISTINCT domain, dialogue_id, seeded FROM HUB) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seeded, dialogue_id) <= 3")
def sc18_few_shot_examples(spark, d):
    return J.examples(_hub(spark, d).select("domain", "dialogue_id", "seeded").distinct(), 3).select("domain", "dialogue_id", "seeded")


@_query("""SELECT rec_id, CASE WHEN len(turns) > 0 THEN coalesce((SELECT string_agg(""" + _strip("text") + """, ' ' ORDER BY i) FROM T WHERE T.rec_id = D.rec_id), '') ELSE '' END AS body FROM D""")
def pr2_stripped_texts(spark, d):
    return _d(spark, d).select("rec_id", F.array_join(F.transform("turns", lambda t: D.strip(t["text"])), " ").alias("body"))


@_query(f"""SELECT domain, CASE WHEN domain IN ('hotel', 'restaurant', 'taxi', 'train', 'attraction', 'booking', 'flight', 'car_rental', 'event') THEN 'booking' WHEN domain IN ('clinic', 'health', 'healthcare') THEN 'healthcare' ELSE 'general' END AS vertical, count(*) AS n FROM D GROUP BY 1, 2""")
def pr8_verticals(spark, d):
    return _d(spark, d).groupBy("domain", J.vertical(F.col("domain")).alias("vertical")).agg(F.count("*").alias("n"))


@_query("""SELECT rec_id, CAST(i AS INTEGER) AS turn_id, CASE WHEN role = 'User' THEN 'User' ELSE 'SupportBot' END AS role, round(coalesce(score, 0), 6) AS quality FROM T""")
def pr10_stored_from_display(spark, d):
    shown = pr9_display_projection(spark, d)
    return shown.select("rec_id", "turn_id", F.when(F.col("speaker") == "user", "User").otherwise("SupportBot").alias("role"), F.round(F.col("judge_score") / 5, 6).alias("quality"))


@_query(f""", {_BODYWORDS} SELECT * FROM (PIVOT (SELECT domain, metric, round(avg(x), 6) AS m FROM (SELECT domain, 'distinct_1' AS metric, d1 AS x FROM G2 UNION ALL SELECT domain, 'distinct_2', d2 FROM G2) GROUP BY 1, 2) ON metric IN ('distinct_1', 'distinct_2') USING first(m) GROUP BY domain)""")
def pr26_wide_from_long(spark, d):
    long = _distinct(spark, d).select("domain", F.col("d1").alias("distinct_1"), F.col("d2").alias("distinct_2")).unpivot("domain", ["distinct_1", "distinct_2"], "metric", "x")
    return long.groupBy("domain").pivot("metric", ["distinct_1", "distinct_2"]).agg(F.round(F.avg("x"), 6))


@_query("""SELECT rec_id, 'Subgoals: ' || array_to_string(coalesce(s.unresolved_goals, []), ', ') || '; Constraints: ' || coalesce(array_to_string(list_transform(list_sort(map_keys(s.slots)), lambda k: k || '=' || array_to_string(list_transform(list_sort(map_keys(s.slots[k])), lambda q: q || ':' || coalesce(s.slots[k][q], '')), '/')), ', '), '') AS goal_text
    FROM (SELECT rec_id, pipeline_turns[len(pipeline_turns)].memory_snapshot AS s FROM dialogues WHERE len(pipeline_turns) > 0) WHERE s IS NOT NULL""", ctes=False)
def pr21_structured_goals(spark, d):
    s = F.col("s")
    inner = lambda m: F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda q: F.concat(q, F.lit(":"), F.coalesce(F.try_element_at(m, q), F.lit("")))), "/")
    held = F.array_join(F.transform(F.array_sort(F.map_keys(s["slots"])), lambda k: F.concat(k, F.lit("="), inner(F.try_element_at(s["slots"], k)))), ", ")
    rows = table(spark, d, "dialogues").where(F.size("pipeline_turns") > 0).select("rec_id", F.get("pipeline_turns", F.size("pipeline_turns") - 1)["memory_snapshot"].alias("s")).where("s IS NOT NULL")
    return rows.select("rec_id", F.concat(F.lit("Subgoals: "), F.array_join(F.coalesce(s["unresolved_goals"], F.array().cast("array<string>")), ", "), F.lit("; Constraints: "), F.coalesce(held, F.lit(""))).alias("goal_text"))


@_query(f""", Q AS (SELECT domain, CAST(rec_id % 60 AS INTEGER) AS ref_idx, count(*) AS n FROM D GROUP BY 1, 2), G AS (SELECT {_DOMAIN} AS domain, pos, goal FROM seed_goals)
    SELECT Q.domain, ref_idx, n, coalesce(a.goal, b.goal) AS reference FROM Q LEFT JOIN G a ON a.domain = Q.domain AND a.pos = ref_idx LEFT JOIN G b ON b.domain = Q.domain AND b.pos = 0""")
def j5_reference_by_index(spark, d):
    name = F.coalesce(F.nullif(F.lower(D.strip(F.col("domain"))), F.lit("")), F.lit("unknown"))
    rows = _d(spark, d).groupBy("domain", (F.col("rec_id") % 60).cast("int").alias("ref_idx")).agg(F.count("*").alias("n"))
    return J.by_reference(rows, table(spark, d, "seed_goals").select(name.alias("domain"), "pos", "goal"))


@_query("""SELECT d.rec_id, count(a.annotation_id) AS n_annotations, count(DISTINCT a.annotator_id) AS n_annotators, count(*) FILTER (a.annotation_id IS NULL) > 0 AS open FROM dialogues d LEFT JOIN (SELECT DISTINCT annotation_id, annotator_id, dialogue_id FROM annotations) a USING (dialogue_id) GROUP BY 1""", ctes=False)
def j9_tasks_and_annotations(spark, d):
    done = table(spark, d, "annotations").select("annotation_id", "annotator_id", "dialogue_id").distinct()
    tasks = table(spark, d, "dialogues").select("rec_id", "dialogue_id")
    return tasks.join(done, "dialogue_id", "left").groupBy("rec_id").agg(F.count("annotation_id").alias("n_annotations"), F.countDistinct("annotator_id").alias("n_annotators"), (F.count_if(F.col("annotation_id").isNull()) > 0).alias("open"))


@_query(f"""SELECT D.rec_id, D.dialogue_id, u.rec_id IS NOT NULL AS unknown_entities, b.rec_id IS NOT NULL AS breaks FROM D LEFT JOIN ({_dialogue_sql()['v26_unknown_entities']}) u USING (rec_id) LEFT JOIN ({_dialogue_sql()['v29_incoherent_transitions']}) b USING (rec_id)""")
def j10_dialogues_with_results(spark, d):
    base = _d(spark, d)
    marks = D.failures(base).select("rec_id", F.array_contains("categories", "hallucinated_entities").alias("unknown_entities"), F.array_contains("categories", "incoherent_transitions").alias("breaks"))
    return base.select("rec_id", "dialogue_id").join(marks, "rec_id")


@_query(f"""SELECT arm, domain, count(*) AS n FROM (SELECT unnest(['full', 'no_memory', 'no_planner', 'no_reflection', 'single_agent']) AS arm, {_DOMAIN} AS domain FROM seed_goals) GROUP BY 1, 2""", ctes=False)
def j11_arms_by_seed(spark, d):
    seeds = table(spark, d, "seed_goals").select(F.coalesce(F.nullif(F.lower(D.strip(F.col("domain"))), F.lit("")), F.lit("unknown")).alias("domain"), "pos")
    return J.arms_by_seed(["full", "no_memory", "no_planner", "no_reflection", "single_agent"], seeds).groupBy("arm", "domain").agg(F.count("*").alias("n"))


@_query(f"""SELECT source, count(*) AS n, count(DISTINCT dialogue_id) AS n_ids FROM (SELECT 'stored' AS source, dialogue_id FROM dialogues UNION ALL SELECT 'incoming', dialogue_id FROM incoming_dialogues) GROUP BY 1""", ctes=False)
def o3_concatenated_corpora(spark, d):
    each = [table(spark, d, name).select(F.lit(kind).alias("source"), "dialogue_id") for kind, name in (("stored", "dialogues"), ("incoming", "incoming_dialogues"))]
    return each[0].unionByName(each[1]).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("dialogue_id").alias("n_ids"))


@_query("""SELECT version_id, array_to_string(list_sort(list_distinct(list(domain))), ',') AS domains FROM D GROUP BY 1""")
def t9_sorted_domains(spark, d):
    return _d(spark, d).groupBy("version_id").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))


@_query("""SELECT rec_id, CAST(i AS INTEGER) AS turn_id FROM T WHERE i % 3 = 0""")
def w12_every_third_turn(spark, d):
    return D.turn_rows(_d(spark, d)).where(F.col("turn_id") % 3 == 0).select("rec_id", "turn_id")


@_query("""SELECT rec_id, CAST(i AS INTEGER) AS turn_id, ['greet', 'ask', 'refine', 'confirm', 'close'][CAST((row_number() OVER (PARTITION BY rec_id ORDER BY i) - 1) % 5 AS INTEGER) + 1] AS template FROM T WHERE role = 'User'""")
def w13_rotated_templates(spark, d):
    users = F.filter(F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), (i + 1).alias("turn_id"))), lambda t: t["role"] == "User")
    names = F.array(*map(F.lit, ["greet", "ask", "refine", "confirm", "close"]))
    return _d(spark, d).select("rec_id", F.inline(F.transform(users, lambda t, k: F.struct(t["turn_id"].alias("turn_id"), F.get(names, k % 5).alias("template")))))


@_query("""SELECT rec_id, sha256(coalesce(dialogue_id, '') || '|' || goal)[1:16] AS checksum, left(md5(goal), 8) AS goal_hash FROM D""")
def s15_checksums(spark, d):
    return _d(spark, d).select("rec_id", F.left(F.sha2(F.concat(F.coalesce("dialogue_id", F.lit("")), F.lit("|"), F.col("goal")), 256), F.lit(16)).alias("checksum"), F.left(F.md5("goal"), F.lit(8)).alias("goal_hash"))


@_query("""SELECT rec_id, strftime(ingested_at, '%Y%m%d_%H%M%S') AS stamp, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM dialogues WHERE ingested_at IS NOT NULL""", ctes=False)
def s17_timestamps(spark, d):
    return table(spark, d, "dialogues").where("ingested_at IS NOT NULL").select("rec_id", F.date_format("ingested_at", "yyyyMMdd_HHmmss").alias("stamp"), F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@_query(rf""", K AS (SELECT rec_id, string_split({_clean('goal')}, ' ') AS w, goal FROM D) SELECT rec_id, CASE WHEN len(w) > 8 THEN array_to_string(list_concat(w[1:3], w[-5:]), ' ') ELSE goal END AS prompt FROM K""")
def s3_prompt_windows(spark, d):
    return _d(spark, d).select("rec_id", X.head_and_tail(F.col("goal"), 8, 3).alias("prompt"))


@_query(r"""SELECT annotation_id, coalesce(CAST(nullif(regexp_extract(comments, '\b([1-5])\b', 1), '') AS DOUBLE), 3.0) AS score FROM annotations""", ctes=False)
def s19_scores_in_comments(spark, d):
    return table(spark, d, "annotations").select("annotation_id", X.score_in(F.col("comments")).alias("score"))


@_query(r"""SELECT feed, count(*) AS n, count(*) FILTER (CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' ELSE false END) AS n_objects FROM snapshot_records GROUP BY 1""", ctes=False)
def jn1_objects_in_noise(spark, d):
    noisy = F.concat(F.lit("Here you are:\n```json\n"), F.col("raw"), F.lit("\n```\nAnything else?"))
    return table(spark, d, "snapshot_records").groupBy("feed").agg(F.count("*").alias("n"), F.count_if(X.json_object(noisy).isNotNull() & X.json_object(F.col("raw")).isNotNull()).alias("n_objects"))


@_query(f"""SELECT rec_id, CASE WHEN count(*) FILTER ({_strip('text')} <> '') >= 2 THEN count(*) FILTER ({_strip('text')} <> '') ELSE 0 END AS n_parsed FROM T GROUP BY 1""")
def s21_parsed_transcripts(spark, d):
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), F.regexp_replace(t["text"], r"[\r\n]+", " "))), "\n")
    return _d(spark, d).where(F.size("turns") > 0).select("rec_id", F.coalesce(F.size(O.turns_of(flat)), F.lit(0)).cast("long").alias("n_parsed"))


@_query("""SELECT rec_id, count(*) AS n_conflicts FROM (SELECT rec_id, i, dom, slot, v, lag(v) OVER (PARTITION BY rec_id, dom, slot ORDER BY i) AS before FROM (SELECT rec_id, i, dom, slot, sl[slot] AS v FROM (SELECT rec_id, i, dom, m[dom] AS sl, unnest(map_keys(m[dom])) AS slot FROM
        (SELECT rec_id, i, m, unnest(map_keys(m)) AS dom FROM (SELECT rec_id, generate_subscripts(pipeline_turns, 1) AS i, unnest(pipeline_turns).memory_snapshot.slots AS m FROM dialogues)))) WHERE v IS NOT NULL) WHERE before IS NOT NULL AND before <> v GROUP BY 1""", ctes=False)
def mp1_slot_conflicts(spark, d):
    return memory.conflicts(table(spark, d, "dialogues")).groupBy("rec_id").agg(F.count("*").alias("n_conflicts"))


@_query("""SELECT rec_id, count(*) AS n_slots, count(*) FILTER (contains(coalesce(body, ''), lower(v))) AS n_said FROM (SELECT rec_id, unnest(map_values(m)) AS v FROM (SELECT rec_id, unnest(map_values(pipeline_turns[len(pipeline_turns)].memory_snapshot.slots)) AS m FROM dialogues)) LEFT JOIN W USING (rec_id) WHERE v IS NOT NULL GROUP BY 1""")
def mp2_slot_values_said(spark, d):
    slots = F.get("pipeline_turns", F.size("pipeline_turns") - 1)["memory_snapshot"]["slots"]
    held = table(spark, d, "dialogues").select("rec_id", F.filter(F.flatten(F.transform(F.map_values(slots), lambda m: F.map_values(m))), lambda v: v.isNotNull()).alias("v")).where(F.size("v") > 0)
    both = held.join(_d(spark, d).select("rec_id", "body"), "rec_id")
    return both.select("rec_id", F.size("v").cast("long").alias("n_slots"), F.size(F.filter("v", lambda x: F.col("body").contains(F.lower(x)))).cast("long").alias("n_said"))


@_query("""SELECT domain, status, count(*) AS n FROM (SELECT """ + _DOMAIN + """ AS domain, CASE metadata.quality_assessment.passed_filters WHEN true THEN 'accepted' WHEN false THEN 'rejected' ELSE 'pending' END AS status FROM dialogues) GROUP BY 1, 2""", ctes=False)
def v38_status_counts(spark, d):
    name = F.coalesce(F.nullif(F.lower(D.strip(F.col("domain"))), F.lit("")), F.lit("unknown"))
    passed = F.col("metadata.quality_assessment.passed_filters")
    status = F.when(passed, "accepted").when(~passed, "rejected").otherwise("pending")
    return table(spark, d, "dialogues").groupBy(name.alias("domain"), status.alias("status")).agg(F.count("*").alias("n"))


@_query(f"""{_REPORT.replace("SELECT metric, count(x) AS n", ", REP AS (SELECT metric, count(x) AS n", 1)}) SELECT metric, CAST(round(100 * mean) AS BIGINT) AS percent, mean >= CASE metric WHEN 'distinct_1' THEN 0.46 WHEN 'distinct_2' THEN 0.46 WHEN 'completed' THEN 0.85 ELSE 0 END AS target_met FROM REP WHERE metric <> 'n_turns'""")
def pr25_summary_table(spark, d):
    targets = F.create_map(*[F.lit(x) for kv in {"distinct_1": 0.46, "distinct_2": 0.46, "completed": 0.85}.items() for x in kv])  # fixed values
    rows = a19_research_report(spark, d).where("metric <> 'n_turns'")
    return rows.select("metric", F.round(100 * F.col("mean")).cast("long").alias("percent"), (F.col("mean") >= F.coalesce(targets[F.col("metric")], F.lit(0.0))).alias("target_met"))


@_query(r"""SELECT domain, CAST(sum(len(list_filter(regexp_split_to_array(goal, '\s+'), lambda w: w <> ''))) AS BIGINT) AS n_tokens FROM D GROUP BY 1""")
def x1_whitespace_tokens(spark, d):
    return _d(spark, d).groupBy("domain").agg(F.sum(F.size(F.filter(F.split("goal", r"\s+"), lambda w: w != ""))).alias("n_tokens"))


@_query("""SELECT domain, round(avg(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / CAST(len(w) AS DOUBLE) END), 6) AS goal_distinct FROM (SELECT domain, regexp_extract_all(lower(goal), '[\\p{L}\\p{N}_]+') AS w FROM D) GROUP BY 1""")
def u1_metric_over_extracted_text(spark, d):
    return J.distinct_over(_d(spark, d), lambda: F.col("goal")).groupBy("domain").agg(_r(F.avg("distinct_1"), "goal_distinct"))


@_query("""SELECT D.rec_id, round(len(list_intersect(g, b)) / CAST(greatest(len(g), 1) AS DOUBLE), 6) AS score FROM (SELECT D.rec_id, list_distinct(string_split(lower(goal), ' ')) AS g, list_distinct(string_split(coalesce(body, ''), ' ')) AS b FROM D LEFT JOIN W USING (rec_id)) D""")
def u2_plugged_scorer(spark, d):
    def overlap(goal: str, body: str) -> float:
        g, b = set(goal.lower().split(" ")), set(body.split(" "))
        return len(g & b) / max(1, len(g))

    return _d(spark, d).select("rec_id", F.round(J.scorer(overlap)("goal", "body"), 6).alias("score"))


@_query("""SELECT D.rec_id, 'Goal: ' || goal || chr(10) || 'Conversation:' || chr(10) || coalesce(s, '') || chr(10) || 'Score from 1 to 5:' AS prompt FROM D LEFT JOIN (SELECT rec_id, string_agg(role || ': ' || text, chr(10) ORDER BY i) AS s FROM T WHERE i > n - 6 GROUP BY 1) USING (rec_id)""")
def s20_judge_prompts(spark, d):
    return _d(spark, d).select("rec_id", J.judge_prompt(6).alias("prompt"))


# what a model would have answered about the last memory of a dialogue: JSON in a noisy text
_LAST_MEMORY = """WITH L AS (SELECT rec_id, context, p.memory_snapshot AS m, p.reflection_score AS r FROM (SELECT rec_id, context, pipeline_turns[len(pipeline_turns)] AS p FROM dialogues WHERE len(pipeline_turns) > 0))"""
_kept = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: {_strip('x')}), lambda x: coalesce(x, '') <> '')"


def _answers(spark, d, **fields) -> DataFrame:
    last = F.get("pipeline_turns", F.size("pipeline_turns") - 1)
    rows = table(spark, d, "dialogues").where(F.size("pipeline_turns") > 0).select("rec_id", "context", last["memory_snapshot"].alias("m"), last["reflection_score"].alias("r"))
    body = F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in fields.items()]))
    return rows.select("rec_id", F.concat(F.lit("Sure, here it is:\n```json\n"), body, F.lit("\n```")).alias("t"))


@_query(f"{_LAST_MEMORY} SELECT rec_id, {_kept('m.user_facts')}[1:10] AS user_facts, {_kept('m.support_facts')}[1:10] AS support_facts FROM L", ctes=False)
def jn3_facts_of_answers(spark, d):
    return _answers(spark, d, user_facts="m.user_facts", support_facts="m.support_facts").select("rec_id", O.facts(F.col("t")).alias("f")).select("rec_id", "f.user_facts", "f.support_facts")


@_query(f"""{_LAST_MEMORY} SELECT rec_id, array_to_string(list_filter([CASE WHEN m.unresolved_goals IS NULL THEN 'missing_subgoals' END, 'missing_missing_information', CASE WHEN r IS NULL THEN 'missing_goal_progress' END, 'missing_next_action', 'not_a_text_dialogue_state', CASE WHEN context IS NULL THEN 'missing_reasoning' END], lambda x: x IS NOT NULL), '|') AS issues FROM L""", ctes=False)
def v32_issues_of_plans(spark, d):
    return _answers(spark, d, subgoals="m.unresolved_goals", goal_progress="r", dialogue_state="7", reasoning="context").select("rec_id", F.array_join(O.plan_issues(F.col("t")), "|").alias("issues"))


@_query(f"""{_LAST_MEMORY} SELECT rec_id, coalesce(len({_kept('m.unresolved_goals')}), 0) AS n_subgoals, coalesce({_strip('r')}, '') AS progress, coalesce({_strip('context')}, '') AS reasoning FROM L""", ctes=False)
def jn4_normal_plans(spark, d):
    p = _answers(spark, d, subgoals="m.unresolved_goals", goal_progress="r", reasoning="context").select("rec_id", O.plan(F.col("t")).alias("p"))
    return p.select("rec_id", F.size("p.subgoals").cast("long").alias("n_subgoals"), F.col("p.goal_progress").alias("progress"), "p.reasoning")


@_query(rf"""{_LAST_MEMORY}, X AS (SELECT rec_id, least(5, coalesce(TRY_CAST(nullif(regexp_extract(r, 'score=(\d+)', 1), '') AS DOUBLE), 0)) AS score, {_kept('m.unresolved_goals')} AS i FROM L) SELECT rec_id, score, len(i) AS n_issues, score >= 4 AND (len(i) = 0 OR score >= 5) AS accepted FROM X""", ctes=False)
def v33_accepted_reflections(spark, d):
    v = _answers(spark, d, score="CAST(nullif(regexp_extract(r, 'score=([0-9]+)', 1), '') AS int)", issues="m.unresolved_goals").select("rec_id", O.verdict(F.col("t")).alias("v"))
    return v.select("rec_id", "v.score", F.size("v.issues").cast("long").alias("n_issues"), "v.accepted")


_SEVERITY = "CASE length({x}) % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' WHEN 2 THEN 'odd' END"


@_query(f"""{_LAST_MEMORY}, X AS (SELECT rec_id, {_kept('m.user_facts')}[1:8] AS f FROM (SELECT rec_id, m FROM L)), Y AS (SELECT rec_id, f, list_transform(f, lambda x: CASE length(x) % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) AS s FROM X)
    SELECT rec_id, len(f) AS n, CASE list_max(s) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS worst FROM Y""", ctes=False)
def a36_worst_contradictions(spark, d):
    facts = "transform(filter(m.user_facts, x -> x IS NOT NULL), x -> regexp_replace(x, '^[\\\\s\\\\p{Z}\\\\p{C}]+|[\\\\s\\\\p{Z}\\\\p{C}]+$', ''))"
    text = f"transform({facts}, x -> named_struct('text', x, 'severity', {_SEVERITY.format(x='x')}))"
    c = _answers(spark, d, contradictions=text).select("rec_id", O.contradictions(F.col("t")).alias("c"))
    return c.select("rec_id", F.size("c").cast("long").alias("n"), O.worst(F.col("c")).alias("worst"))


@_query(f"""{_LAST_MEMORY} SELECT rec_id, {_kept('m.support_facts')}[1:12] AS milestones, CASE WHEN coalesce({_strip('context')}, '') <> '' THEN left({_strip('context')}, 4000) ELSE 'as before' END AS summary FROM L""", ctes=False)
def jn6_milestones_and_summaries(spark, d):
    return _answers(spark, d, milestones="m.support_facts", summary="context").select("rec_id", O.milestones(F.col("t")).alias("milestones"), O.summary(F.col("t"), F.lit("as before")).alias("summary"))


@_query(f"""SELECT rec_id, CAST(i - 1 AS INTEGER) AS pos, {_strip('t.metadata.plan')} AS plan, {_strip('t.text')} <> '' AS replied FROM (SELECT rec_id, unnest(turns) AS t, generate_subscripts(turns, 1) AS i FROM dialogues) WHERE {_strip('t.metadata.plan')} <> '' AND t.text IS NOT NULL""", ctes=False)
def s18_plans_and_replies(spark, d):
    rows = table(spark, d, "dialogues").select("rec_id", F.posexplode("turns").alias("pos", "t")).where((D.strip(F.col("t.metadata.plan")) != "") & F.col("t.text").isNotNull())
    said = rows.select("rec_id", "pos", F.col("t.text").alias("text"), O.plan_and_reply(F.concat(F.lit("plan: "), F.col("t.metadata.plan"), F.lit("\nREPLY: SupportBot: "), F.col("t.text"))).alias("p"))
    # a reply ends with the text that was said, but for quotes around it
    ends = F.col("text").contains(F.col("p.reply")) & (F.col("p.reply") != "")
    return said.select("rec_id", "pos", "p.plan", ends.alias("replied"))


@_query("""SELECT rec_id, CAST(i AS INTEGER) AS turn_id FROM T WHERE i > n - 3""")
def st6_live_turns(spark, d):
    last = F.slice(F.transform("turns", lambda t, i: F.struct((i + 1).alias("turn_id"))), F.greatest(F.size("turns") - 2, F.lit(1)), F.lit(3))
    return _d(spark, d).select("rec_id", F.inline(last))


@_query("""SELECT rec_id, score FROM D WHERE score >= 0.7 ORDER BY rec_id LIMIT 100""")
def t4_first_accepted(spark, d):
    return _d(spark, d).where("score >= 0.7").select("rec_id", "score").orderBy("rec_id").limit(100)


_HEAD = lambda c: f"list_transform(list_sort(list_transform(list_filter(coalesce({c}, []), lambda x, i: x IS NOT NULL AND NOT regexp_matches(x, '^ *$') AND list_position({c}, x) = i), lambda x: struct_pack(i := list_position({c}, x), x := x)))[1:12], lambda s: s.x)"


def _last_memory(spark, d) -> DataFrame:
    last = F.get("pipeline_turns", F.size("pipeline_turns") - 1)["memory_snapshot"]
    return table(spark, d, "dialogues").where(F.size("pipeline_turns") > 0).select("rec_id", last["user_facts"].alias("u"), last["support_facts"].alias("s"), last["unresolved_goals"].alias("g"))


@_query(f"""{_LAST_MEMORY} SELECT rec_id, concat_ws(chr(10), CASE WHEN len({_HEAD('m.user_facts')}) > 0 THEN 'User facts: ' || array_to_string({_HEAD('m.user_facts')}, '; ') END,
    CASE WHEN len({_HEAD('m.support_facts')}) > 0 THEN 'Support facts: ' || array_to_string({_HEAD('m.support_facts')}, '; ') END, CASE WHEN len({_HEAD('m.unresolved_goals')}) > 0 THEN 'Open goals: ' || array_to_string({_HEAD('m.unresolved_goals')}, '; ') END) AS section FROM L""", ctes=False)
def pr27_memory_sections(spark, d):
    head = lambda c: memory.unique_head(F.coalesce(c, F.array().cast("array<string>")))
    return _last_memory(spark, d).select("rec_id", memory.section(head(F.col("u")), head(F.col("s")), head(F.col("g"))).alias("section"))


@_query(f"{_LAST_MEMORY} SELECT rec_id, {_HEAD('m.user_facts')} AS user_facts, {_HEAD('m.support_facts')} AS support_facts, {_HEAD('m.unresolved_goals')} AS unresolved_goals FROM L", ctes=False)
def pr29_stored_memories(spark, d):
    rows = _last_memory(spark, d).select("rec_id", memory.stored(F.col("u"), F.col("s"), F.col("g")).alias("t"))
    return rows.select("rec_id", memory.read(F.col("t")).alias("m")).select("rec_id", "m.*")


@_query("""SELECT rec_id, CAST(len(turns) AS INTEGER) AS num_turns, CASE WHEN s IS NULL OR isnan(s) THEN 0 ELSE s END AS quality_score, coalesce(t, 0) AS generation_time_seconds, coalesce(v, 'unknown') AS model_version, strftime(ingested_at, '%Y-%m-%d') AS generated_at
    FROM (SELECT rec_id, coalesce(turns, []) AS turns, ingested_at, metadata.quality_score AS s, metadata.generation_time_seconds AS t, metadata.model_version AS v FROM dialogues)""", ctes=False)
def pr6_metadata_of_records(spark, d):
    m = F.col("metadata")
    score = F.when(~F.isnan(m["quality_score"]), m["quality_score"])
    made = memory.new_metadata(F.size(F.coalesce("turns", F.array())), score, m["generation_time_seconds"], m["model_version"], F.date_format("ingested_at", "yyyy-MM-dd"))
    return table(spark, d, "dialogues").select("rec_id", made.alias("m")).select("rec_id", "m.*")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
