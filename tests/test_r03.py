"""What moves and what is stored: findings of the third round."""

import json

import pandas as pd
from pyspark.sql import functions as F

from gleaner.operators import intake, preparation
from gleaner.operators.requests import ModelOptions
from gleaner.plans import build as plans
from gleaner.plans.build import Build, Options, group_schema
from gleaner.plans.fixtures import echo


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_not_shuffled_to_leave_out_seeds(spark):
    """F4 to F8: a group's seeds are left out where its articles' passages are joined."""
    text = "A body's density is its mass divided by its volume, and that holds for each of its parts."
    corpus = preparation.scored(spark.createDataFrame([(a, f"{a}#{i}", "", f"{text} {i}") for a in "12" for i in range(4)], "article_id string, passage_id string, title string, text string"))
    seeds = preparation.scored(spark.createDataFrame([("g", 0, "doc:1#0", "1#0", "", f"{text} 0"), ("g", 1, "doc:2#3", "2#3", "", f"{text} 3"), ("h", 0, "doc:1#0", "1#0", "", f"{text} 0")], "group_id string, pos int, source_id string, passage_id string, title string, text string"))
    found = preparation.article_candidates(seeds, corpus, "doc:", 3)
    got = sorted((r.group_id, r.passage_id, r.is_seed) for r in found.collect())
    assert got == [("g", "1#0", True), ("g", "1#1", False), ("g", "1#2", False), ("g", "2#0", False), ("g", "2#1", False), ("g", "2#2", False), ("g", "2#3", True), ("h", "1#0", True), ("h", "1#1", False), ("h", "1#2", False)]
    assert "LeftAnti" not in _plan(found)


def test_a_line_is_parsed_once(spark):
    """the filter of refused lines does not parse them again."""
    lines = spark.createDataFrame([("{",), ("[]",), (" ",)], "value string")
    refused = intake.quarantine(intake.parsed_groups(lines, ("documents",)))
    assert sorted(r.problem for r in refused.collect())[0] == "$: no JSON" and refused.count() == 2
    once = _plan(intake.parsed_groups(lines, ("documents",)).select("problem")).count("try_parse_json")
    assert _plan(refused.select("problem")).count("try_parse_json") == once


def test_waves_do_not_grow_with_the_calls(spark, tmp_path, monkeypatch):
    """more calls than MOST_WAVES waves hold make the waves larger, and all are asked."""
    monkeypatch.setattr(plans, "MOST_WAVES", 3)
    asked = spark.range(20).select(F.concat(F.lit("g"), "id").alias("group_id"), F.lit("echo").alias("stage"), F.sha2(F.col("id").cast("string"), 256).alias("call_sha256"), F.lit(1).alias("attempt"), F.lit("b").alias("body"))
    build = Build(spark, str(tmp_path / "r"), echo, Options(model=ModelOptions(concurrency=2), calls_kept_together=1))
    build.ask(asked, "echo", 1)
    assert spark.read.parquet(build.path("call_progress")).count() == 3
    assert spark.read.parquet(build.path("responses")).select("call_sha256").distinct().count() == 20


def _slow_of_wit(batches):
    """g1 is answered well at once, g2 only when told what was wrong."""
    for b in batches:
        good = json.dumps({"question": "Why?", "assumptions": [], "evidence": [{"source_id": "a", "passage_id": "p", "quote": "quoted"}]})
        fine = [g == "g1" or "That did not pass: no JSON" in x for g, x in zip(b["group_id"], b["body"])]
        raw = [json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": good if f else "hm"}}]}) for f in fine]
        yield pd.DataFrame({"call_sha256": b["call_sha256"], "status_code": 200, "raw": raw, "latency_s": 0.0})


def _refuses(batches):
    raise RuntimeError("asked again")
    yield


def test_rounds_hold_no_texts(spark, tmp_path):
    """messages are stored with the requests alone; a retry carries answer and problem; a second run asks nothing."""
    rows = spark.createDataFrame([(g, 0, "s", "documents", "en", [("a", "p", "", "what is quoted")]) for g in ("g1", "g2")], group_schema())
    rows = rows.withColumns({"record": F.lit("{}"), "candidates": F.lit(0), "review": F.lit(None).cast("string")})
    build = Build(spark, str(tmp_path / "r"), _slow_of_wit, Options(model=ModelOptions(concurrency=1)))
    found = sorted((r.group_id, r.payload is not None, r.error) for r in build.stage("application", rows).collect())
    assert found == [("g1", True, None), ("g2", True, None)]
    for name in ("rounds/application-1", "rounds/application-2", "checked/application-1", "checked/application-2"):
        assert not {"messages", "body", "passages"} & set(spark.read.parquet(build.path(name)).columns)
    assert {len(r.messages) for r in spark.read.parquet(build.path("requests/application")).collect()} == {2}
    again = Build(spark, str(tmp_path / "r"), _refuses, Options(model=ModelOptions(concurrency=1)))
    assert sorted((r.group_id, r.payload is not None, r.error) for r in again.stage("application", rows).collect()) == found
