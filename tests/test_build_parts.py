"""Parts of the build that need no whole run: what a model is asked, prepared candidates, input checks, collected answers."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions.records import STAGE_SPECS, STAGES
from gleaner.functions.strict import json_schema
from gleaner.operators import requests
from gleaner.plans.build import RESPONSE, Build, Collected, Options, group_schema, supplied, validated
from gleaner.plans.prompts import PROMPTS
from tests.scripted import scripted_model

TEXT = "The density of a body is its mass divided by its volume, and bodies of greater density sink in water, number {}."


def seeds_of(groups):
    return groups.select("group_id", F.posexplode("passages").alias("pos", "p")).select("group_id", "pos", "p.*")


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(f"g{i}", i, "physics", "documents", "en", [(f"s:{i}#{k}", f"{i}#{k}", "T", TEXT.format(f"{i} {k}")) for k in range(2)]) for i in range(3)]
    return spark.createDataFrame(rows, group_schema())


def test_every_stage_has_a_prompt_and_a_closed_schema():
    for stage in STAGES:
        schema = json_schema(STAGE_SPECS[stage])
        assert schema["type"] == "object" and schema["additionalProperties"] is False and set(schema["required"]) <= set(schema["properties"])
        assert stage in PROMPTS or stage == "repair_review"
    card = json_schema(STAGE_SPECS["extraction"])["properties"]["cards"]
    assert card["maxItems"] == 3 and card["items"]["properties"]["card"]["properties"]["trigger"]["minItems"] == 1
    grounding = card["items"]["properties"]["grounding"]["items"]["properties"]
    assert grounding["item_index"] == {"type": ["integer", "null"], "minimum": 0} and grounding["support_type"]["enum"] == ["direct", "derived"]
    assert json_schema(STAGE_SPECS["card_repair"])["properties"]["repairs"]["items"]["properties"]["replacement"]["type"] == ["object", "null"]


@pytest.mark.parametrize("endpoint,where", [("chat/completions", "$.response_format.json_schema.schema.type"), ("responses", "$.text.format.schema.type")])
def test_a_call_can_name_its_schema(spark, endpoint, where):
    messages = F.array(requests.message("user", F.lit("hi")))
    options = requests.ModelOptions(endpoint=endpoint)
    schema = json.dumps(json_schema(STAGE_SPECS["solution"]))
    body = spark.range(1).select(requests.request_body(messages, options, requests.format_of("solution", schema, endpoint)).alias("b")).first().b
    value = json.loads(body)
    for part in where.removeprefix("$.").split("."):
        value = value[part]
    assert value == "object"


def test_candidates_are_reused_while_they_are_as_they_were(spark, groups, tmp_path):
    made = []

    def preparer(seeds):
        made.append(1)
        return supplied(Options().limits)(seeds)

    build = Build(spark, str(tmp_path / "r"), scripted_model, preparer=preparer)
    first = build.candidates(seeds_of(groups)).collect()
    assert sorted(build.candidates(seeds_of(groups)).collect()) == sorted(first) and len(made) == 1
    spark.createDataFrame(first[1:], build.candidates(seeds_of(groups)).schema).write.mode("overwrite").parquet(build.path("candidate_audit"))
    assert sorted(build.candidates(seeds_of(groups)).collect()) == sorted(first) and len(made) == 2


def test_input_is_checked_without_a_model(spark):
    line = lambda g, text: json.dumps({"group_id": g, "subject": "s", "corpus": "documents", "language": "en", "passages": [{"source_id": "a", "passage_id": "b", "text": text}]})
    lines = spark.createDataFrame([(line("g1", "one"),), (line("g2", "two"),), (line("g2", "two"),), ("{",), (" ",)], "value string")
    groups, refused, broken = validated(lines, ("documents",))
    assert groups.count() == 3 and [r.problem for r in refused.collect()] == ["$: no JSON"]
    assert {(r.violation, r.key) for r in broken.collect()} == {("duplicate group_id", "g2"), ("conflicting texts", "a|b")}
    with pytest.raises(ValueError):
        validated(lines.where("value = ' '"), ("documents",))


def test_collected_answers_are_joined(spark):
    asked = spark.createDataFrame([("g1", "solution", "c1", 1, "b"), ("g1", "solution", "c2", 2, "b"), ("g2", "solution", "c3", 1, "b")], "group_id string, stage string, call_sha256 string, attempt int, body string")
    answers = spark.createDataFrame([("g1", "solution", 2, 200, "{}", 0.5), ("g9", "solution", 1, 200, "{}", 0.5)], "group_id string, stage string, attempt int, status_code int, raw string, latency_s double")
    out = Collected(answers).to(asked)
    assert [tuple(r) for r in out.collect()] == [("c2", 200, "{}", 0.5)] and out.columns == [x.split()[0] for x in RESPONSE.split(", ")]


def test_a_callers_validator_log_and_progress(spark, groups, tmp_path):
    """A validator's errors are retried and then errors of their group; calls are logged with stage, attempt and time; stages count their groups."""
    bad = (F.col("group_id") == "g1") & (F.col("stage") == "solution")
    validate = lambda rows: rows.withColumn("errors", F.when(bad, F.array(F.lit("not to my liking"))).otherwise(F.expr("cast(array() as array<string>)")))
    build = Build(spark, str(tmp_path / "r"), scripted_model, Options(model=requests.ModelOptions(concurrency=2, retries=1), schema_in_call=True), validate=validate)
    out = {r.group_id: r for r in build.run(groups).collect()}
    assert out["g1"].status == "error" and out["g1"].error == "solution: not to my liking"
    assert all("not to my liking" not in (r.error or "") for g, r in out.items() if g != "g1")
    log = spark.read.parquet(build.path("responses")).collect()
    assert all(r.stage in STAGES and r.attempt in (1, 2) and r.called_at is not None and r.group_id in out for r in log)
    assert {r.attempt for r in log if r.group_id == "g1" and r.stage == "solution"} == {1, 2}
    progress = {r.stage: r for r in spark.read.parquet(build.path("stage_progress")).collect()}
    assert progress["application"].groups == 3 and progress["solution"].failed >= 1
    asked = json.loads(spark.read.parquet(build.path("requests/solution")).first().messages[1].content)
    assert asked["required_output_schema"] == json_schema(STAGE_SPECS["solution"]) and "application" in asked["construction_record"]
