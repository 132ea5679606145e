import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


DIALOGUES = (
    "rec_id bigint, version_id string, ingested_at timestamp, dialogue_id string, goal string, domain string, context string, user_persona string, "
    "turns array<struct<role:string,text:string,timestamp:string,metadata:struct<plan:string,tools_used:array<string>,fallback:boolean>>>, "
    "pipeline_turns array<struct<turn:int,user_response:string,support_response:string,reflection_score:string,memory_snapshot:struct<user_facts:array<string>,support_facts:array<string>,slots:map<string,map<string,string>>,unresolved_goals:array<string>>,timings_ms:map<string,double>>>, "
    "metadata struct<num_turns:int,quality_score:double,generated_at:string,model_version:string,llm_provider:string,generation_time_seconds:double,stop_reason:string,goal_complexity:int,user_persona_traits:string,supportbot_style:string,"
    "quality_assessment:struct<dialogue_id:string,domain:string,overall_score:double,passed_filters:boolean,assessment_timestamp:string>>"
)


def record(rec_id, texts=None, *, pairs=None, plans=None, facts=None, assessed=None, score=None, domain="hotel", model="m", context=None, name=None, goal="Book a room"):
    import datetime

    turns = None if texts is None else [None if t is Ellipsis else ("User" if i % 2 == 0 else "SupportBot", t, None, ((plans or {}).get(i), None, None)) for i, t in enumerate(texts)]
    pipeline = None
    if pairs is not None or facts is not None:
        pipeline = [(k, q, a, None, (((facts or {}).get(k)), None, None, None) if facts else None, None) for k, (q, a) in enumerate(pairs if pairs is not None else [("q", "a")] * len(facts))]
    meta = (None, score, None, model, None, None, None, None, None, None, assessed)
    return (rec_id, "v1", datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=rec_id), name or f"d{rec_id}", goal, domain, context, None, turns, pipeline, meta)


@pytest.fixture
def dialogues(spark):
    return lambda *rows: spark.createDataFrame(list(rows), DIALOGUES)
