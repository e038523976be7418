"""The whole build with a scripted model: gates, lineage, retry, resume, identity and damage."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from gleaner.operators.requests import ModelOptions
from gleaner.plans.build import Build, Options, group_schema
from tests.scripted import answer, scripted_model

TEXT = "A lever lifts a heavy load with a small push, if the long arm is on the side of the hand that pushes it, as in case {}."


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(f"g{i}", i, "physics", "documents", "en", [(f"s:{i}#{k}", f"{i}#{k}", "T", TEXT.format(f"{i} {k}")) for k in range(2)]) for i in range(30)]
    rows.append(("bad", 30, "physics", "documents", "en", [("s:30#0", "30#0", "T", "short")]))
    return spark.createDataFrame(rows, group_schema())


def counting(folder):
    """The scripted model, leaving a file for each call."""
    import os

    def model(batches):
        for batch in batches:
            for row in batch.itertuples():
                open(os.path.join(folder, row.call_sha256), "a").close()
            yield from scripted_model(iter([batch]))

    return model


@pytest.fixture(scope="module")
def built(spark, groups, tmp_path_factory):
    calls, folder = tmp_path_factory.mktemp("calls"), str(tmp_path_factory.mktemp("run") / "r")
    build = Build(spark, folder, counting(str(calls)), Options(model=ModelOptions(concurrency=4)))
    return build, build.run(groups).collect(), calls, folder


def test_outcomes_follow_the_gates(built):
    build, outcomes, _, _ = built
    by = {r.group_id: r for r in outcomes}
    assert len(by) == 31 and by["bad"].rejection_stage == "source_preparation" and by["bad"].application is None
    for g, r in by.items():
        assert r.status != "error", r.error
        if r.rejection_stage == "self_check":
            assert r.extraction is None
        if r.status == "accepted":
            assert r.card_review is not None and r.rejection_stage is None
        if r.card_repair is None:
            assert r.repair_review is None
    assert {"accepted", "rejected"} <= {r.status for r in outcomes}
    assert any(r.repair_review for r in outcomes)


def test_bank_and_summary(spark, built):
    build, outcomes, _, folder = built
    bank, summary = build.bank().orderBy("index").collect(), build.summary().first()
    assert [r["index"] for r in bank] == list(range(len(bank))) and summary.cards == len(bank) > 0
    accepted = {r.group_id for r in outcomes if r.status == "accepted"}
    origins = build.origins().collect()
    assert {o.origin.group_id for o in origins} == accepted and len(origins) == sum(r.n_origins for r in bank)
    assert summary.accepted == len(accepted) and summary.groups == 31 and summary.complete and summary.calls > 0 and summary.prompt_tokens > 0
    assert summary.groups_with_repair == sum(r.card_repair is not None for r in outcomes)
    for r in bank:
        assert set(r.card.asDict()) == {"concept_name", "definition", "trigger", "decision", "pitfall"} and r.memory_id == "mem_" + r.content_key
        mine = sorted((o for o in origins if o.content_key == r.content_key), key=lambda o: o.origin_no)
        assert [o.origin_no for o in mine] == list(range(1, r.n_origins + 1)) and (mine[0].group_order, mine[0].card_index) == (r.group_order, r.card_index)
        for o in mine:
            assert len(o.origin.grounding) == 2 + len(r.card.trigger) + len(r.card.decision) + len(r.card.pitfall)
    cards = spark.read.json(f"{folder}/export/cards")
    assert cards.count() == len(bank) == spark.read.json(f"{folder}/export/bank").count()
    assert spark.read.parquet(f"{folder}/card_rejections").count() == summary.rejected_card_reviews


def test_resume_calls_nothing(spark, groups, built):
    build, outcomes, calls, folder = built
    before = {p.name: p.stat().st_mtime_ns for p in calls.iterdir()}
    again = Build(spark, folder, counting(str(calls)), Options(model=ModelOptions(concurrency=2))).run(groups).collect()
    assert sorted(map(str, again)) == sorted(map(str, outcomes))
    # this run asked nothing, so it used nothing
    assert build.summary().first().asDict()["calls"] == build.summary().first().asDict()["total_tokens"] == 0
    # failed first attempts are no results: what was valid in the end is found without asking
    assert {p.name: p.stat().st_mtime_ns for p in calls.iterdir()} == before


def test_changed_options_need_another_folder(spark, groups, built):
    _, _, calls, folder = built
    for changed, rows in ((Options(model=ModelOptions(name="other")), groups), (Options(repairs=0), groups), (Options(), groups.where("group_order > 0"))):
        with pytest.raises(ValueError):
            Build(spark, folder, scripted_model, changed).run(rows)


def test_damaged_results_are_errors_of_their_group(spark, groups, built, tmp_path):
    folder = str(tmp_path / "r")
    shutil.copytree(built[3], folder)
    victim = next(r.group_id for r in built[1] if r.status == "accepted")
    rows = spark.read.parquet(f"{folder}/stage_results")
    torn = rows.withColumn("payload", F.when((F.col("group_id") == victim) & (F.col("stage") == "solution"), F.lit("{}")).otherwise(F.col("payload"))).collect()
    spark.createDataFrame(torn, rows.schema).write.mode("overwrite").parquet(f"{folder}/stage_results")
    out = {r.group_id: r for r in Build(spark, folder, scripted_model, Options(model=ModelOptions(concurrency=4))).run(groups).collect()}
    assert out[victim].status == "error" and "checksum" in out[victim].error
    assert {g: r.status for g, r in out.items() if g != victim} == {r.group_id: r.status for r in built[1] if r.group_id != victim}


def faulty(kind):
    def model(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.itertuples():
                message = json.loads(json.loads(row.body)["messages"][1]["content"])
                said = answer(row.stage, message["passage_group"], message["construction_record"])
                if kind == "quote" and row.stage == "application":
                    said["evidence"][0]["quote"] = "never written"
                if kind == "coverage" and row.stage == "extraction":
                    for c in said["cards"]:
                        c["grounding"] = c["grounding"][1:]
                out.append((row.call_sha256, 503 if kind == "down" else 200, json.dumps({"choices": [{"message": {"content": json.dumps(said)}}]}), 0.0))
            yield pd.DataFrame(out, columns=["call_sha256", "status_code", "raw", "latency_s"])

    return model


@pytest.mark.parametrize("kind,words", [("quote", "no exact quotation"), ("down", "application: ")])
def test_what_never_gets_right_is_an_error(spark, groups, tmp_path, kind, words):
    few = groups.where("group_order < 2")
    out = Build(spark, str(tmp_path / "r"), faulty(kind), Options(model=ModelOptions(retries=1))).run(few).collect()
    assert all(r.status == "error" and words in r.error and r.solution is None for r in out)
    responses = spark.read.parquet(str(tmp_path / "r" / "responses"))
    assert responses.count() == 4  # two attempts each, and no stage after


def test_options_are_checked():
    with pytest.raises(ValueError):
        Options(repairs=2)


def test_arriving_groups(spark, groups, tmp_path):
    from gleaner.streaming.arrivals import build_arrivals

    few = groups.where("group_order < 2")
    few.write.parquet(str(tmp_path / "in"))
    seen = []

    class Kept:
        def run(self, batch):
            seen.extend(r.group_id for r in batch.collect())

    stream = spark.readStream.schema(few.schema).parquet(str(tmp_path / "in"))
    query = build_arrivals(stream, lambda batch, i: Kept(), str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert sorted(seen) == ["g0", "g1"]


def test_groups_with_broken_seeds_are_errors_and_call_nothing(spark, tmp_path):
    from gleaner.operators.preparation import Limits
    from gleaner.plans.build import same_article

    texts = {f"{i}#{k}": TEXT.format(f"{i} {k}") for i in range(4) for k in range(2)}
    corpus = spark.createDataFrame([(p.split("#")[0], p, "T", t) for p, t in texts.items()], "article_id string, passage_id string, title string, text string")
    seeds = {"good": ("s:0#0", "0#0", "T", texts["0#0"]), "edited": ("s:1#0", "1#0", "T", texts["1#0"] + " Edited."), "absent": ("s:9#0", "9#0", "T", TEXT.format(9)), "prefix": ("x:2#0", "2#0", "T", texts["2#0"])}
    groups = spark.createDataFrame([(g, i, "physics", "documents", "en", [p]) for i, (g, p) in enumerate(seeds.items())], group_schema())
    calls = tmp_path / "calls"
    calls.mkdir()
    preparer = same_article(corpus, "s:", Limits())
    out = {r.group_id: r for r in Build(spark, str(tmp_path / "r"), counting(str(calls)), Options(model=ModelOptions(concurrency=2)), preparer).run(groups).collect()}
    assert out["good"].status != "error" and out["good"].application is not None
    for g, words in (("edited", "differs from the corpus: 1#0"), ("absent", "not found in the corpus: 9#0"), ("prefix", "does not match the corpus prefix: 2#0")):
        assert out[g].status == "error" and out[g].error.startswith("source_preparation: ") and words in out[g].error and out[g].application is None
    assert {r.group_id for r in spark.read.parquet(str(tmp_path / "r" / "requests" / "application")).collect()} == {"good"}


def test_groups_that_break_the_rules_stop_the_run(spark, groups, tmp_path):
    for i, (rows, words) in enumerate(((groups.limit(0), "at least one"), (groups.where("group_order < 2").unionByName(groups.where("group_order < 1")), "duplicate group_id"))):
        with pytest.raises(ValueError, match=words):
            Build(spark, str(tmp_path / str(i)), scripted_model, Options()).run(rows)


def test_outputs_are_sealed_while_they_are_written(spark, built, tmp_path):
    folder = str(tmp_path / "r")
    shutil.copytree(built[3], folder)
    copy = Build(spark, folder, scripted_model)
    sealed = {r.output: r.rows for r in spark.read.parquet(f"{folder}/seals").collect()}
    assert set(sealed) == {"synthesis_records", "rejected_records", "errors", "card_rejections", "bank_table", "bank_origins", *(f"export/{x}" for x in ("cards", "bank", "bank_origins", "bank_metadata"))}
    assert sealed["synthesis_records"] == 31 and sealed["bank_table"] == sealed["export/cards"] == spark.read.json(f"{folder}/export/cards").count()
    assert copy.broken() == []
    rows = spark.read.json(f"{folder}/export/bank").collect()
    spark.createDataFrame(rows[1:] + [rows[1]]).write.mode("overwrite").json(f"{folder}/export/bank")
    assert copy.broken() == ["export/bank"]


def test_a_round_that_is_killed_half_way_keeps_its_answers(spark, tmp_path):
    calls, folder = tmp_path / "calls", str(tmp_path / "r")
    calls.mkdir()
    said = json.dumps({"choices": [{"message": {"content": "{}"}}]})

    def answers(batches):
        import pandas as pd

        for batch in batches:
            for c in batch["call_sha256"]:
                (calls / c).touch()
            yield pd.DataFrame({"call_sha256": [*batch["call_sha256"], "of nobody"], "status_code": 200, "raw": said, "latency_s": 0.0})

    def dies(batches):
        for batch in batches:
            if len(list(calls.iterdir())) >= 10:
                raise RuntimeError("the service is gone")
            yield from answers(iter([batch]))

    options = Options(model=ModelOptions(concurrency=2), calls_kept_together=2)
    todo = spark.createDataFrame([(f"g{i}", "application", f"c{i}", 1, "{}") for i in range(30)], "group_id string, stage string, call_sha256 string, attempt int, body string")
    with pytest.raises(Exception, match="the service is gone"):
        Build(spark, folder, dies, options).call(todo, "application", 1)
    known = {r.call_sha256 for r in spark.read.parquet(f"{folder}/responses").collect()}
    before = {p.name: p.stat().st_mtime_ns for p in calls.iterdir()}
    waves = spark.read.parquet(f"{folder}/call_progress").orderBy("wave").collect()
    assert known <= set(before) and sum(w.answered for w in waves) <= len(known) < 30
    assert len(waves) > 0 and [w.wave for w in waves] == list(range(1, len(waves) + 1)) and {w.waves for w in waves} == {8}
    got = Build(spark, folder, answers, options).call(todo, "application", 1).collect()
    assert sorted(r.call_sha256 for r in got) == sorted(f"c{i}" for i in range(30)) and {r.raw for r in got} == {said}
    # whatever was kept is not asked again; the rest is
    after = {p.name: p.stat().st_mtime_ns for p in calls.iterdir()}
    assert {c: after[c] for c in known} == {c: before[c] for c in known}
    log = spark.read.parquet(f"{folder}/responses").collect()
    assert sorted(r.call_sha256 for r in log) == sorted(r.call_sha256 for r in got) and len({r.run for r in log if r.call_sha256 not in known}) == 1


def test_only_damaged_candidates_are_prepared_again(spark, groups, tmp_path):
    from gleaner.operators.preparation import Limits
    from gleaner.plans.build import supplied

    asked = []

    def preparer(seeds):
        asked.append({r.group_id for r in seeds.select("group_id").distinct().collect()})
        return supplied(Limits())(seeds)

    folder = str(tmp_path / "r")
    seeds = groups.select("group_id", F.posexplode("passages").alias("pos", "p")).select("group_id", "pos", "p.*")
    first = Build(spark, folder, scripted_model, preparer=preparer).candidates(seeds).collect()
    assert asked == [{r.group_id for r in groups.collect()}]
    again = Build(spark, folder, scripted_model, preparer=preparer).candidates(seeds).collect()
    assert sorted(map(str, again)) == sorted(map(str, first)) and len(asked) == 1
    # one row is damaged, one group has another seed
    rows = spark.read.parquet(f"{folder}/candidate_audit")
    rows = spark.createDataFrame(rows.withColumn("usage_cues", F.when((F.col("group_id") == "g3") & (F.col("passage_id") == "3#0"), F.lit(9)).otherwise(F.col("usage_cues"))).collect(), rows.schema)
    rows.write.mode("overwrite").parquet(f"{folder}/candidate_audit")
    changed = seeds.withColumn("text", F.when(F.col("passage_id") == "5#1", F.concat("text", F.lit(" More."))).otherwise(F.col("text")))
    third = Build(spark, folder, scripted_model, preparer=preparer).candidates(changed)
    assert asked[1:] == [{"g3", "g5"}]
    plain = lambda x: sorted(str(r) for r in x if r.group_id != "g5")
    assert plain(third.collect()) == plain(first)
    assert sum(r.group_id == "g5" for r in third.collect()) == 2
