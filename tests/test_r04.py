"""What a build reads, moves and works out, and how often: findings of the fourth round."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions.records import STAGE_SPECS
from gleaner.functions.strict import plainly_fits, spark_type, violations
from gleaner.operators import preparation
from gleaner.operators.preparation import Limits
from gleaner.operators.requests import ModelOptions
from gleaner.plans.build import Build, Collected, Options, candidate_errors, group_schema, same_article

GOOD = {"cards": [{"card": {"concept_name": "c", "definition": 'd "ü"\n', "trigger": ["t"], "decision": ["e"], "pitfall": []}, "grounding": [{"field": "trigger", "item_index": 0, "evidence": [{"source_id": "s", "passage_id": "p", "quote": "q"}], "support_type": "direct", "rationale": "r"}]}]}


def _changed(f):
    value = json.loads(json.dumps(GOOD))
    f(value["cards"][0], value["cards"][0]["grounding"][0])
    return json.dumps(value)


def test_a_payload_that_plainly_fits_is_not_walked(spark):
    """the typed check says yes to good payloads, and to none that the walk finds wrong."""
    good = [json.dumps(GOOD), json.dumps(GOOD, indent=1), '{"cards": []}', _changed(lambda c, g: g.update(item_index=None))]
    bad = [
        "{}", '{"cards": null}', '{"cards": [], "more": 1}', '{"cards": [null]}', json.dumps({"cards": GOOD["cards"] * 4}), _changed(lambda c, g: g.update(item_index=-1)), _changed(lambda c, g: g.update(item_index=1.0)),
        _changed(lambda c, g: g.update(item_index="0")), _changed(lambda c, g: g.pop("item_index")), _changed(lambda c, g: g.update(rationale=5)), _changed(lambda c, g: g.update(rationale="  ")), _changed(lambda c, g: g.update(rationale=None)),
        _changed(lambda c, g: g.update(field="title")), _changed(lambda c, g: g.update(evidence=[])), _changed(lambda c, g: c["card"].update(trigger=[])), _changed(lambda c, g: c["card"].update(trigger="t")), _changed(lambda c, g: c.update(card=[])),
    ]
    spec, value = STAGE_SPECS["extraction"], F.col("v")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], "i int, x string").withColumn("v", F.parse_json("x")).withColumn("t", F.to_json("v")).withColumn("s", F.from_json("t", spark_type(spec)))
    got = rows.select("i", plainly_fits(value, F.col("t"), F.col("s"), spec).alias("fits"), violations(value, spec).alias("wrong")).orderBy("i").collect()
    assert [(r.fits, not r.wrong) for r in got] == [(True, True)] * len(good) + [(False, False)] * len(bad)


def test_faults_of_candidates_by_group(spark):
    """one pass by group finds what missing_seeds() and repeated_candidates() find."""
    seeds = spark.createDataFrame([("a", "s1", "1"), ("a", "s2", "2"), ("b", "s1", "1"), ("c", None, "7"), ("e", "s5", "5")], "group_id string, source_id string, passage_id string")
    found = spark.createDataFrame([("a", "s1", "1"), ("a", "s1", "1"), ("b", "s1", "1"), ("b", "s3", "3"), ("c", None, "7"), ("d", "s4", "4"), ("d", "s4", "4")], "group_id string, source_id string, passage_id string")
    got = {r.group_id: r.error for r in candidate_errors(seeds, found).collect()}
    assert got == {"a": "repeated candidate: 1", "c": "seed is not among the candidates: 7", "d": "repeated candidate: 4", "e": "seed is not among the candidates: 5"}
    assert {r.group_id for r in preparation.missing_seeds(seeds, found).collect()} == {"a", "c", "e"} and {r.group_id for r in preparation.repeated_candidates(found).collect()} == {"a", "d"}


def test_answers_are_collected_for_the_groups_as_prepared(spark, tmp_path):
    """groups are prepared once, in the run, and what collects answers is given them; passages stand in rank order, with their texts."""
    text = "A body's density is its mass divided by its volume, and that holds for each of its parts, number {}."
    corpus = spark.createDataFrame([("1", f"1#{i}", "T", text.format(i) + (" Only if it is not hollow." if i == 2 else "")) for i in range(4)], "article_id string, passage_id string, title string, text string")
    groups = spark.createDataFrame([("g", 7, "s", "documents", "en", [("doc:1#1", "1#1", "T", text.format(1)), ("doc:1#0", "1#0", "T", text.format(0))])], group_schema())

    class Enough(Exception):
        pass

    def collect(prepared):
        raise Enough([(r.group_id, r.group_order, [(p.source_id, p.text[-9:]) for p in r.passages]) for r in prepared.collect()])

    with pytest.raises(Enough) as e:
        Build(spark, str(tmp_path / "r"), Collected(collect), preparer=same_article(corpus, "doc:", Limits())).run(groups)
    assert e.value.args[0] == [("g", 7, [("doc:1#0", "number 0."), ("doc:1#1", "number 1."), ("doc:1#2", "t hollow."), ("doc:1#3", "number 3.")])]


def test_a_round_reads_its_own_answers(spark, tmp_path):
    """answers and responses of other stages and attempts are left out where they are read; the first call's hash needs no message."""
    said = lambda x: json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": x}}]})
    good = json.dumps({"question": "Why?", "assumptions": [], "evidence": [{"source_id": "a", "passage_id": "p", "quote": "quoted"}]})
    calls = [("g1", "application", 1, good), ("g1", "application", 2, "hm"), ("g2", "application", 1, "hm"), ("g2", "application", 2, f"```json\n{good}\n```"), ("g1", "solution", 1, good), ("g2", "solution", 1, good)]
    answers = spark.createDataFrame([(g, s, a, 200, said(x), 0.0) for g, s, a, x in calls], "group_id string, stage string, attempt int, status_code int, raw string, latency_s double")
    rows = spark.createDataFrame([(g, 0, "s", "documents", "en", [("a", "p", "", "what is quoted")]) for g in ("g1", "g2")], group_schema())
    rows = rows.withColumns({"record": F.lit("{}"), "candidates": F.lit(0), "review": F.lit(None).cast("string")})
    build = Build(spark, str(tmp_path / "r"), Collected(answers), Options(model=ModelOptions(concurrency=1)))
    assert sorted((r.group_id, r.payload is not None, r.error) for r in build.stage("application", rows).collect()) == [("g1", True, None), ("g2", True, None)]
    log = spark.read.parquet(build.path("responses")).collect()
    assert sorted((r.group_id, r.stage, r.attempt) for r in log) == [("g1", "application", 1), ("g2", "application", 1), ("g2", "application", 2)]
    asked = {r.first_call for r in spark.read.parquet(build.path("requests/application")).collect()}
    assert asked == {r.call_sha256 for r in log if r.attempt == 1}
    answers.write.partitionBy("stage").parquet(str(tmp_path / "answers"))
    todo = spark.read.parquet(build.path("rounds/application-1"))
    of = Collected(spark.read.parquet(str(tmp_path / "answers"))).of_round(todo, "solution", 1)
    plan = of._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stage" in plan and sorted(r.group_id for r in of.collect()) == ["g1", "g2"]
