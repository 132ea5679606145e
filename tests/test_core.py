import json

import pytest
from conftest import record
from pyspark.sql import functions as F

from turnloom.functions import stats, text
from turnloom.operators import dialogues as D
from turnloom.operators import memory, nearest, nested, reports, schema_drift
from turnloom.sources import readers, tables, writers
from turnloom.streaming import memory_stream


def lines(spark, files):
    rows = [(feed, name, at, k, raw) for feed, name, at, raws in files for k, raw in enumerate(raws)]
    return spark.createDataFrame(rows, "feed string, file_name string, written_at string, line_no int, raw string").withColumn("written_at", F.col("written_at").cast("timestamp"))


def test_schema_changes(spark):
    a = [json.dumps({"id": str(k), "m": {"style": "warm and chatty", "turn": k % 3}, "x": [{"u": "say"}]}) for k in range(9)]
    b = [json.dumps({"id": str(k), "m": {"bot_style": "warm and chatty", "turn": str(k % 3)}, "x": [{"u": "say", "v": 1.5}]}) for k in range(9)]
    c = [json.dumps({"id": str(k), "m": {"bot_style": "warm and chatty"}, "x": None}) for k in range(9)] + ["{broken", "[1]", None]
    found = schema_drift.changes(lines(spark, [("f", "z", "2026-01-01", a), ("f", "a", "2026-01-02", b), ("f", "b", "2026-01-03", c + c), ("g", "q", "2026-01-03", a)]))
    got = {tuple(r)[1:] for r in found.collect()}
    assert got == {
        ("a", "renamed", "m.style", "m.bot_style"), ("a", "added", "x.v", ""), ("a", "type_changed", "m.turn", ""),
        ("b", "removed", "m.turn", ""), ("b", "removed", "x.v", ""), ("b", "removed", "x.u", ""),
    }


def test_scalars_that_become_objects(spark):
    """The scalar and its change stay, in this feed and in those where it is one all along."""
    a, b = [json.dumps({"plan": f"go {k}", "k": k, "Feed": k}) for k in range(5)], [json.dumps({"plan": {"text": f"go {k}"}, "k": k, "Feed": k}) for k in range(5)]
    c = [json.dumps({"plan": k, "k": None, "list": []}) for k in range(5)]
    found = schema_drift.changes(lines(spark, [("f", "1", "2026-01-01", a), ("f", "2", "2026-01-02", b), ("g", "1", "2026-01-01", a), ("g", "2", "2026-01-02", c)]))
    assert {tuple(r) for r in found.collect()} == {("f", "2", "renamed", "plan", "plan.text"), ("g", "2", "type_changed", "plan", ""), ("g", "2", "removed", "Feed", ""), ("g", "2", "added", "list", "")}
    wide = schema_drift.consistent(lines(spark, [("g", "1", "2026-01-01", a), ("g", "2", "2026-01-02", c)]))
    assert set(wide.columns) == {"feed", "file_name", "line_no", "Feed_2", "k", "plan"} and wide.count() == 10


def test_schema_consistent_and_empty(spark):
    a, b = [json.dumps({"s": "calm mood", "n": 1})] * 3, [json.dumps({"style_s": ["calm mood"], "n": "2"})] * 3
    table = schema_drift.consistent(lines(spark, [("f", "1", "2026-01-01", a), ("f", "2", "2026-01-02", b)]))
    assert dict(table.dtypes) == {"feed": "string", "file_name": "string", "line_no": "int", "n": "string", "s": "array<string>"} or "style_s" in table.columns
    assert {r["n"] for r in table.collect()} == {"1", "2"} and {tuple(r[table.columns[-1]]) for r in table.collect()} == {("calm mood",)}
    assert schema_drift.consistent(lines(spark, [("f", "1", "2026-01-01", ["{", None])])).columns == ["feed", "file_name", "line_no"]
    assert schema_drift.changes(lines(spark, [("f", "1", "2026-01-01", ["{"])])).count() == 0


def test_nested_children(dialogues):
    rows = dialogues(
        record(1, ["a", ..., "b"], plans={0: "p", 2: "  "}, facts={0: ["x", None, " ", "y"]}, assessed=(" D1 ", None, None, None, None)),
        record(2, None, assessed=(None, None, None, None, None)), record(3, []), record(1, ["a"], plans={0: "p"}),
    ).withColumn("child", F.lit("clash"))
    got = sorted(tuple(r) for r in nested.children(rows).select("child", "rec_id", "pos", "item").collect())
    assert got == [("assessment", 1, 0, 0), ("assessment_broken", 2, 0, 0), ("plan", 1, 0, 0), ("plan", 1, 0, 0), ("user_fact", 1, 0, 0), ("user_fact", 1, 0, 3)]
    stored = {r["body"]: r["n_occurrences"] for r in nested.objects(nested.bridge(rows)).collect()}
    assert stored["plan|1:p"] == 2
    assert nested.bridge(rows.limit(0)).count() == 0


def test_every_parent_is_a_stored_object(dialogues):
    rows = dialogues(record(1, ["a", ..., "b"], plans={0: "p"}, facts={0: ["x", None], 1: None}, assessed=("d1", None, 0.5, None, None), score=float("nan")), record(2, None), record(3, ["a"], plans={0: "p"}), record(4, ["a"], plans={0: "p"}, name="d3"))
    b = nested.bridge(rows)
    held = nested.objects(b).select(F.col("node_id").alias("parent_id"))
    assert b.where("parent_id IS NOT NULL").join(held, "parent_id", "left_anti").count() == 0
    assert b.where("child <> 'record' AND parent_id IS NULL").count() == 0
    of = {r["rec_id"]: r["node_id"] for r in b.where("child = 'record'").collect()}
    assert of[3] == of[4] and len(set(of.values())) == 3  # stored twice, one identity
    bodies = {r["node_id"]: r["body"] for r in b.collect()}
    assert all(k == __import__("hashlib").sha256(v.encode()).hexdigest() for k, v in bodies.items())


def test_text_functions(spark):
    df = spark.createDataFrame([(" A  b\na ", "b c"), ("", "")], "x string, y string")
    got = df.select(text.clean(F.col("x")), text.jaccard(text.pieces(F.col("x")), text.pieces(F.col("y"))), text.truncate(F.lit("abcdefgh"), 6), text.head_and_tail(F.lit("a b c d e"), 4, 1), text.score_in(F.lit("is 4.")), text.json_object(F.lit('so ```json {"a": 1}``` x')).cast("string")).collect()
    assert tuple(got[0]) == ("A b a", 1 / 3, "abc...", "a c d e", 4.0, '{"a":1}') and got[1][1] == 1.0


def test_intervals(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    r = df.agg(*stats.mean_interval(F.col("x"))).first()
    assert r["n"] == 4 and r["mean"] == 2.5 and r["low"] == pytest.approx(2.5 - 1.96 * r["std"] / 2)
    low, high = df.limit(1).select(*stats.wilson(F.lit(8), F.lit(10))).first()
    assert (low, high) == (pytest.approx(0.4901568, abs=1e-6), pytest.approx(0.9433191, abs=1e-6))
    assert tuple(df.limit(1).select(*stats.wilson(F.lit(0), F.lit(0))).first()) == (0.0, 1.0)


def test_checks_and_failures(dialogues):
    talk = ["I need a cheap hotel with parking downtown", "The Grand Plaza Hotel is free", "tell me about the weather tomorrow morning", "It rains a lot", "tell me about the weather tomorrow morning", "Zig zag zog zug"]
    d = D.normal(dialogues(record(1, talk, goal="cheap hotel parking downtown"), record(2, None, goal=None, domain="  "), record(3, ["damn", None])))
    checks = {r["rec_id"]: r for r in D.checks(d).collect()}
    assert checks[1]["length_ok"] and checks[1]["roles_ok"] and checks[1]["goal_ok"] and not checks[3]["language_ok"] and not checks[2]["roles_ok"]
    failed = {r["rec_id"]: set(r["categories"]) for r in D.failures(d).collect()}
    assert failed[1] == {"goal_drift", "hallucinated_entities", "repeated_questions", "incoherent_transitions"} and failed[2] == set() and "forgotten_slots" not in failed[3]
    assert {r["category"]: r["n"] for r in reports.failure_counts(D.failures(d)).collect()}["goal_drift"] == 1
    assert d.where("rec_id = 2").first()["domain"] == "unknown"


def test_bleu_and_tfidf(spark):
    assert nearest.bleu("a b c d".split(), "a b c d".split()) == pytest.approx(1.0) and nearest.bleu(["a"], ["b"]) == 0.0
    refs = spark.createDataFrame([("h", 0, "quiet room"), ("h", 1, "late table"), ("h", 2, "corner seat")], "domain string, pos int, goal string")
    q = spark.createDataFrame([("h", "a late table please"), ("x", "none")], "domain string, goal string")
    assert [tuple(r)[2] for r in nearest.nearest_by_tfidf(q, refs).collect()] == [1]
    assert [r["domain"] for r in nearest.best_bleu(q, refs, 2).collect()] == ["h"]


def test_map_changes_and_memory(spark, dialogues):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": None})], "o map<string,int>, n map<string,int>")
    assert [tuple(x) for x in df.select(reports.map_changes(F.col("o"), F.col("n")).alias("c")).first()["c"]] == [("a", 1, None), ("b", 2, 3)]
    got = memory.fold(dialogues(record(1, ["a"], facts={0: ["x", " "], 1: ["x", "y"]}))).first()
    assert got["user_facts"] == ["x", "y"] and got["n_slots"] == 0


def test_readers_and_writers(spark, dialogues, tmp_path):
    d = D.normal(dialogues(record(1, ['say "x"\nplease', ""]), record(2, ["b"], domain="taxi")))
    writers.write_lines(d, str(tmp_path / "c.jsonl"))
    assert readers.read_corpus(spark, str(tmp_path / "c.jsonl")).count() == 2
    (tmp_path / "one.json").write_text(json.dumps([{"dialogue_id": "a", "turns": []}, {"dialogue_id": "b"}]))
    (tmp_path / "bad.json").write_text("{")
    assert readers.read_json(spark, str(tmp_path / "*.json")).count() == 2
    (tmp_path / "w.js").write_text(json.dumps({"dialogues": [{"dialogue_id": "a"}]}))
    assert readers.read_wrapped(spark, str(tmp_path / "w.js")).count() == 1
    with pytest.raises(ValueError):
        readers.read_corpus(spark, "x.xml")
    writers.write_store(dialogues(record(1, ["a"]), record(2, ["b"], domain="taxi", score=0.9)), str(tmp_path / "store"))
    assert [r["rec_id"] for r in readers.read_store(spark, str(tmp_path / "store"), ["taxi"], 0.5).collect()] == [2]
    writers.write_csv(d, str(tmp_path / "csv"))
    writers.write_bundle(d, str(tmp_path / "bundle"))
    writers.write_stories(d, str(tmp_path / "stories"))
    assert '- user: "say \\"x\\" please"' in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "stories")).collect())
    assert writers.markdown(d.groupBy("domain").count()).startswith("| domain | count |")
    ref = {"dialogue_id": "m", "services": ["hotel"], "turns": [{"speaker": "USER", "utterance": "hi"}, {"speaker": "SYSTEM", "utterance": ""}]}
    (tmp_path / "ref.js").write_text(json.dumps([ref]))
    assert readers.read_reference_corpus(spark, str(tmp_path / "ref.js")).first()["turns"][0]["role"] == "User"


def test_versions(spark, dialogues, tmp_path):
    v = writers.Versions(spark, str(tmp_path / "v"))
    assert v.list().count() == 0
    v.create("20260101", D.normal(dialogues(record(1, ["a"]))), tags=["x"])
    v.create("20260102", D.normal(dialogues(record(1, ["a"]), record(2, ["b"]))), parent="20260101")
    v.tag("20260102", ["y"])
    assert [(r["version_id"], r["n"]) for r in v.list().collect()] == [("20260102", 2), ("20260101", 1)]
    assert [r["version_id"] for r in v.list(["y"]).collect()] == ["20260102"]
    merged = writers.upsert(v.load("20260101"), v.load("20260102").where("rec_id = 1"))
    assert merged.count() == 1
    v.delete("20260101")
    assert v.list().count() == 1 and not (tmp_path / "v" / "data" / "version_id=20260101").exists()
    # made again with fewer rows: number, description and parent are the new ones, and tags come on top
    v.create("20260102", D.normal(dialogues(record(7, ["c"]))), description="again", parent="20260100")
    v.tag("20260102", ["z"])
    r = v.list().first()
    assert (r["n"], r["description"], r["parent"], r["tags"]) == (1, "again", "20260100", ["z"])


def test_streamed_memory(spark, tmp_path):
    import datetime
    import random

    at = lambda k: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=k)
    schema = "dialogue_id string, turn_id int, ts timestamp, role string, text string, facts array<string>"
    turns = [("a", 0, at(0), "User", "x", ["f"]), ("a", 1, at(1), "User", "x", ["g"]), ("a", 2, at(2), "SupportBot", "y", ["h", "f", "h"]), ("a", 3, at(3), "User", "w", ["i"]), ("b", 0, at(1), "User", "z", None)]
    random.seed(1)
    random.shuffle(turns)
    # out of order across batches, then a turn far later that moves the watermark, then one too late
    batches = [turns[:2], turns[2:], [("c", 0, at(60), "User", "q", [])], [("a", 9, at(2), "User", "late", ["late"])], [("d", 0, at(500), "User", "q", [])], [("d", 1, at(600), "User", "r", [])]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = memory_stream.fold_turns(stream).writeStream.foreachBatch(lambda df, n, k=k: df.write.mode("append").parquet(str(tmp_path / f"out{k}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    seen = [r for k in range(len(batches)) if (tmp_path / f"out{k}").exists() for r in spark.read.parquet(str(tmp_path / f"out{k}")).collect()]
    best = {r["dialogue_id"]: r for r in sorted(seen, key=lambda r: (r["n_turns"], r["closed"]))}
    assert (best["a"]["n_turns"], best["a"]["facts"]) == (3, ["f", "h", "i"]) and best["b"]["n_turns"] == 1
    assert best["a"]["closed"] and best["b"]["closed"]


def test_windows_of_a_real_stream(spark, tmp_path):
    rows = [(k, f"2026-01-01 {h:02}:30:00", "t", 1.0) for k, h in enumerate([0, 0, 1, 5])]
    spark.createDataFrame(rows, "event_id bigint, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = memory_stream.drained(memory_stream.windowed_events(memory_stream.as_stream(spark, str(tmp_path), "events")))
    assert sorted((r["start"].hour, r["n"]) for r in got.collect()) == [(0, 2), (1, 1)]


def test_written_bundles_and_uploads(spark, dialogues, tmp_path):
    d = dialogues(record(1, ["hello", "Zig zag zog zug"], goal="cheap hotel parking downtown"), record(2, None, domain="taxi"))
    counts = {r["category"]: r["n"] for r in writers.write_failures(d, str(tmp_path / "f")).collect()}
    assert len(counts) == 6 and spark.read.json(str(tmp_path / "f" / "dialogues")).count() >= 1
    assert readers.read_metrics(spark, str(tmp_path / "f" / "counts")).count() == 6
    writers.write_store(d, str(tmp_path / "store"))
    assert writers.clear_domain(spark, str(tmp_path / "store"), "taxi") == 1 and readers.read_store(spark, str(tmp_path / "store")).count() == 1
    one = {"dialogue_id": "a", "goal": "g", "domain": "d", "turns": [{"role": "User", "text": "x"}]}
    (tmp_path / "u1.json").write_text(json.dumps({"dialogues": [one, one]}))
    (tmp_path / "u2.json").write_text(json.dumps([{**one, "turns": []}]))
    up = readers.read_uploads(spark, [str(tmp_path / "u1.json"), str(tmp_path / "u2.json")])
    assert up.count() == 3 and "lacks" in readers.upload_problem(up) and readers.upload_problem(up.where("size(turns) > 0")) is None
    assert readers.upload_problem(up.limit(0)) == "no dialogues" and "more than 2" in readers.upload_problem(up, 2)
    writers.write_object(spark, {"a": 1}, str(tmp_path / "o"))
    assert json.loads("".join(r[0] + "\n" for r in spark.read.text(str(tmp_path / "o")).collect())) == {"a": 1}
    writers.write_metrics(up.groupBy("domain").count(), str(tmp_path / "m"))
    frames = [{"service": "taxi", "state": {"active_intent": "i", "slot_values": {}}}, {"service": "train", "state": {"active_intent": "i", "slot_values": {"day": ["monday"], "at": ["9"]}}}]
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "x.json").write_text(json.dumps([{"dialogue_id": "m", "services": ["taxi", "train"], "turns": [{"speaker": "USER", "utterance": "hi", "frames": frames}, {"speaker": "SYSTEM", "utterance": "", "frames": []}]}, {"dialogue_id": "n", "services": [], "turns": [{"speaker": "USER", "utterance": "hi"}]}]))
    ref = readers.read_reference_corpus(spark, str(tmp_path), ["train"]).orderBy("dialogue_id").collect()
    assert [(r["domain"], r["goal"]) for r in ref] == [("train", "at: 9; day: monday"), ("unknown", "Get help with unknown")]
    writers.write_corpus(readers.read_reference_corpus(spark, str(tmp_path), ["train"], 1), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c" / "stats")).count() == 1


def test_conflicts_of_slots(spark, dialogues):
    from turnloom.operators import memory

    snap = lambda slots: (None, None, slots, None)
    row = list(record(1, ["a"], pairs=[("q", "a")] * 4))
    row[9] = [(k, "q", "a", None, snap(s), None) for k, s in enumerate([{"hotel": {"day": "mon", "n": "2"}}, {"hotel": {"day": None}}, {"hotel": {"day": "tue"}, "taxi": None}, None])]
    assert [tuple(r) for r in memory.conflicts(dialogues(tuple(row))).collect()] == [(1, 2, "hotel", "day", "mon", "tue")]


def test_bounded_and_keep(spark):
    df = tables.keep(spark.range(10))
    assert "BroadcastHashJoin" in spark.range(100).join(tables.bounded(df, 10), "id")._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10


def test_model_output(spark):
    from turnloom.functions import model_output as M

    texts = ['ok ```json\n{"subgoals": ["a", " "], "missing_information": [], "goal_progress": " near ", "next_action": 3, "score": 9, "issues": ["x"], "user_facts": ["f"], "contradictions": [{"text": "t", "severity": "HIGH"}, {"text": "u", "severity": "?"}]}\n```', "none", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = df.select(M.plan(F.col("t")).alias("p"), M.plan_issues(F.col("t")).alias("i"), M.verdict(F.col("t")).alias("v"), M.facts(F.col("t")).alias("f"), M.contradictions(F.col("t")).alias("c"), M.worst(M.contradictions(F.col("t"))).alias("w")).collect()
    assert r[0]["p"]["subgoals"] == ["a"] and r[0]["p"]["goal_progress"] == "near"
    assert "missing_dialogue_state" in r[0]["i"] and "not_a_text_next_action" in r[0]["i"] and r[1]["i"] == ["no_object"]
    assert tuple(r[0]["v"]) == (5.0, ["x"], True) and r[1]["v"] is None and r[0]["f"]["user_facts"] == ["f"] and r[2]["f"]["user_facts"] == []
    assert [tuple(c) for c in r[0]["c"]] == [("t", "high"), ("u", "medium")] and [x["w"] for x in r] == ["high", "none", "none"]
    one = spark.range(1).select(M.spoken(F.lit('User: "hi"')), M.plan_and_reply(F.lit("PLAN: go\nREPLY: SupportBot: yes")), M.turns_of(F.lit("User: a\nnoise\nSupportBot: b")), M.turns_of(F.lit("User: a")), M.summary(F.lit("x"), F.lit("old"))).first()
    assert one[0] == "hi" and tuple(one[1]) == ("go", "yes") and len(one[2]) == 2 and one[3] is None and one[4] == "old"


def test_rules_requests_and_loops(dialogues):
    d = D.normal(dialogues(
        record(1, ["I need a room", "Your hotel room is booked, reference X", "thanks, great"], goal="book a hotel room"),
        record(2, ["hello", "hi", "could you book it?"]), record(3, ["thanks", "you're welcome", "perfect", "anything else"]), record(4, None), record(5, ["", ""]),
    ))
    got = {r["rec_id"]: r for r in d.select("rec_id", D.rule_completion().alias("r"), D.open_request().alias("o"), D.loop().alias("l")).collect()}
    assert got[1]["r"]["complete"] and got[1]["r"]["score"] == 1.0 and not got[4]["r"]["complete"]
    assert got[2]["o"] and not got[1]["o"] and got[3]["l"] and not got[1]["l"] and not got[4]["l"]


def test_small_statistics(spark):
    assert stats.shares_of(7, ["a", "b", "c"]) == {"a": 3, "b": 2, "c": 2} and stats.shares_of(3, []) == {}
    assert [stats.histogram_bins(n) for n in (0, 30, 1000)] == [8, 10, 24] and stats.z_of(0.5) == 1.96
    low, high = spark.range(1).select(*stats.normal_interval(F.lit(0.5), F.lit(100))).first()
    assert (low, high) == (pytest.approx(0.402), pytest.approx(0.598))


def test_service_and_human_evaluation(spark, dialogues, tmp_path):
    from turnloom.service import Service
    from turnloom.sources import human

    steps = []
    s = Service(spark, str(tmp_path), lambda step, state: steps.append((step, state)))
    d = dialogues(record(1, ["I want a room", "It is booked", "thanks, perfect"]), record(2, ["a b", "c d"]), record(3, None))
    report = {r["metric"]: r for r in s.evaluate(d).collect()}
    assert set(report) == {"distinct_1", "coherence", "n_turns", "completed", "satisfied", "heuristic"} and report["n_turns"]["n"] == 3 and steps[-1] == ("evaluate", "ends")
    assert {r["metric"]: r["n"] for r in s.evaluate(d, latest=2).collect()}["n_turns"] == 2
    s.versions.create("1", d)
    s.versions.create("2", d.where("rec_id < 3"))
    r = s.compare("1", "2").first()
    assert (r["old_version"], r["new_version"], r["d_count"]) == ("1", "2", -1) and s.records("1", 2).count() == 2
    s.export("1", "stories", str(tmp_path / "s"))
    with pytest.raises(ValueError):
        s.export("1", "nothing", str(tmp_path / "t"))
    h = s.human
    assert h.tasks().count() == 0
    h.add_tasks(d.select("dialogue_id"), "ann")
    task = h.tasks("ann").first()
    assert h.tasks().count() == 3 and not task["done"]
    with pytest.raises(ValueError):
        h.annotate(task["task_id"], "ann", {"coherence": 9})
    with pytest.raises(ValueError):
        h.annotate("none", "ann", {"coherence": 3})
    h.annotate(task["task_id"], "ann", {"coherence": 3, "overall": 5}, task_completed=True)
    h.annotate(task["task_id"], "bob", {"coherence": 5})
    assert h.tasks().where("done").count() == 1 and h.annotations(annotator_id="bob").count() == 1
    assert [(r["n"], r["agreement"], r["std"]) for r in h.agreement().collect()] == [(2, 1.0, 1.0)]
    assert {r["dimension"]: r["mean"] for r in h.statistics().collect()} == {"coherence": 4.0, "overall": 5.0}
    h.export(str(tmp_path / "x"))
    assert human.invalid({"coherence": None, "zeal": 1}) == ["unknown dimension zeal", "coherence out of range"]


def test_merged_partials_and_decisions(spark):
    from turnloom.operators import judging as J

    rows = spark.createDataFrame([(k, float(k % 7), None if k % 5 == 0 else k * 0.5) for k in range(100)], "rec_id int, a double, b double")
    whole = {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in J.merged_report(J.partials(rows, ["a", "b"], [])).collect()}
    parts = {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in J.merged_report(J.partials(rows, ["a", "b"], [(F.col("rec_id") % 9).alias("chunk")])).collect()}
    assert whole == parts and len(whole) == 2
    marks = spark.createDataFrame([(0.2, 3.0, 3.0, True, False), (0.2, 3.0, 3.0, False, False), (0.6, None, None, None, True), (0.2, 5.0, 5.0, True, True)], "h double, c double, o double, r boolean, f boolean")
    args = [F.col(x) for x in "hcorf"]
    assert [r[0] for r in marks.select(J.passes(*args)).collect()] == [True, False, True, False]
    assert [r[0] for r in marks.select(J.passes(*args, strict=False)).collect()] == [True, True, True, False]
    few = spark.createDataFrame([(k, "d", f"x{k}", 0.5) for k in range(3)], "rec_id bigint, domain string, dialogue_id string, score double")
    seeds = spark.createDataFrame([("d", f"s{k}") for k in range(9)], "domain string, dialogue_id string")
    hub = J.few_shot_hub(few, seeds, 1.0)
    assert hub.where("seeded").count() == 5 and J.examples(hub, 2).where("not seeded").count() == 2


def test_first_rows_by_position(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("double").alias("score"), F.col("id").alias("rec_id")).repartition(5)
    for n in (0, 1, 333, 334, 999, 1000, 2000):
        got = [tuple(r) for r in reports.first_rows(rows, [F.desc("score"), "rec_id"], lambda _: n).collect()]
        assert sorted(got) == sorted(sorted([(float(k % 3), k) for k in range(1000)], key=lambda r: (-r[0], r[1]))[:n])
    assert reports.first_rows(rows.limit(0), ["rec_id"], lambda n: 5).count() == 0
