import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from gleaner.functions import responses, text
from gleaner.functions.records import STAGE_SPECS, group_spec
from gleaner.functions.strict import first_problem
from gleaner.operators.intake import group_violations, parsed_groups, quarantine, require_groups, valid_groups

CITE = {"source_id": "a", "passage_id": "p", "quote": "q"}
CARD = {"concept_name": "c", "definition": "d", "trigger": ["t"], "decision": ["e"], "pitfall": []}


def grounding(field, index=None):
    return {"field": field, "item_index": index, "evidence": [CITE], "support_type": "direct", "rationale": "r"}


def problems(spark, spec, *values):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "i int, v string").select("i", first_problem(F.col("v"), spec).alias("p")).collect()
    return [r.p for r in sorted(out)]


def test_closed_schemas(spark):
    good = {"cards": [{"card": CARD, "grounding": [grounding("definition")]}]}
    second = {"cards": [good["cards"][0], {"card": {**CARD, "definition": None}, "grounding": []}]}
    extra = {"cards": [good["cards"][0], {"card": CARD, "grounding": [], "more": 1}]}
    no_index = grounding("definition")
    del no_index["item_index"]
    got = problems(
        spark, STAGE_SPECS["extraction"], good, {"cards": []}, second, extra, {"cards": [{"card": CARD, "grounding": [no_index]}]}, {"cards": [good["cards"][0]] * 4}, {"cards": "no"}, "[1]", "{", {"cards": [{"card": {**CARD, "trigger": []}, "grounding": []}]},
        {"cards": [{"card": {**CARD, "concept_name": 5}, "grounding": []}]}, {"cards": [{"card": {**CARD, "definition": "  "}, "grounding": []}]},
    )
    assert got[:2] == [None, None]
    assert got[2].startswith("$.cards[1].card.definition") and got[3] == "$.cards[1].more: unknown key" and got[4].endswith("item_index: missing")
    assert all(got[5:])
    assert problems(spark, STAGE_SPECS["card_repair"], {"repairs": [{"card_index": 0, "replacement": None, "reason": "r"}]}, {"repairs": []}, {"repairs": [{"card_index": 0, "reason": "r"}]}, {"repairs": [{"card_index": -1, "replacement": None, "reason": "r"}]})[0] is None
    assert problems(spark, STAGE_SPECS["self_check"], '{"a":1,"a":2}')[0].endswith("unknown key")


def group(**changes):
    passage = {"source_id": "s", "passage_id": "1#1", "title": "", "text": "  some text\t"}
    return {"group_id": "g", "subject": "x", "corpus": "documents", "language": "en", "passages": [passage], **changes}


def test_groups_are_read_strictly(spark, tmp_path):
    passage = group()["passages"][0]
    lines = [group(), group(group_id="sep", passages=[{**passage, "text": "one line"}]), group(extra=1), group(language="de"), group(passages=[passage, passage]), group(passages=[]), group(passages=[{**passage, "text": "x" * 12001}])]
    lines += [group(passages=[{**passage, "passage_id": str(k), "text": "x" * 11000} for k in range(3)])]
    path = tmp_path / "g.jsonl"
    path.write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\n\n  \n{broken\n", encoding="utf-8")
    from gleaner.sources.readers import read_lines

    parsed = parsed_groups(read_lines(spark, str(path)), ("documents",))
    ok = {r.group_id: r.passages for r in valid_groups(parsed).collect()}
    assert set(ok) == {"g", "sep"} and ok["g"][0].text == "some text" and " " in ok["sep"][0].text
    assert quarantine(parsed).count() == 7
    with pytest.raises(ValueError):
        require_groups(valid_groups(parsed).limit(0))


def test_group_violations(spark):
    rows = [("g", 0, 0, "s", "1", "a"), ("g", 1, 0, "s", "1", "a"), ("h", 0, 0, "s", "1", "b"), ("i", 0, 0, "s", "2", "  "), ("j", 0, 0, "s", "3", "x" * 12001)]
    rows += [("k", 0, i, "s", "k%d" % i, "x") for i in range(6)] + [("l", 0, 0, "s", "l", "x"), ("l", 0, 1, "s", "l", "x")]
    out = group_violations(spark.createDataFrame(rows, "group_id string, group_row int, pos int, source_id string, passage_id string, text string")).collect()
    assert {(r.violation, r.key) for r in out} == {
        ("duplicate group_id", "g"), ("conflicting texts", "s|1"), ("blank text", "i|s|2"), ("passage too long", "j|s|3"), ("too many passages", "k"), ("duplicate passage in group", "l|s|l"),
    }


def plain_key(subject, card):
    def normal(x):
        if isinstance(x, str):
            return " ".join(unicodedata.normalize("NFC", x).split())
        return [normal(i) for i in x] if isinstance(x, list) else {k: normal(v) for k, v in x.items()}

    value = {"subject": subject, "card": normal(card)}
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_content_key_is_canonical(spark):
    cards = [CARD, {**CARD, "definition": "café    noir\t"}, {**CARD, "definition": "café noir"}, {**CARD, "trigger": ["b", "a"], "pitfall": ['say "x"\\']}, {**CARD, "trigger": ["a", "b"]}]
    schema = "i int, subject string, card struct<concept_name:string,definition:string,trigger:array<string>,decision:array<string>,pitfall:array<string>>"
    out = spark.createDataFrame([(i, "sübject", c) for i, c in enumerate(cards)], schema).select("i", text.content_key(F.col("subject"), F.col("card")).alias("k"), text.render_card(F.col("card")).alias("d")).collect()
    keys = [r.k for r in sorted(out)]
    assert keys == [plain_key("sübject", c) for c in cards]
    assert keys[1] == keys[2] and keys[3] != keys[4]
    assert sorted(out)[0].d == "Description: d\nTrigger:\n- t\nDecision:\n- e\nPitfall:"


def test_small_scalars(spark):
    row = spark.createDataFrame([("  a \t b\n", "a b/c.d-é", "12#10")], "a string, n string, p string").select(
        text.strip(F.col("a")).alias("s"), text.collapse(F.col("a")).alias("c"), text.safe_name(F.col("n")).alias("n"), text.article_of(F.col("p")).alias("p"), text.stable_hash(F.lit("x")).alias("h"), text.is_text(F.lit(" ")).alias("t"),
        text.digest(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"))).alias("d"),
    ).first()
    assert (row.s, row.c, row.n, row.p, row.t) == ("a \t b", "a b", "a_b_c.d-_", "12", False)
    assert row.h == hashlib.sha256(b"x").hexdigest()[:32] and row.d == hashlib.sha256(b'{"a":1,"b":null}').hexdigest()


def test_responses(spark):
    chat = {"choices": [{"finish_reason": "stop", "message": {"content": "hi"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}
    typed = {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "other", "text": "x"}, {"type": "output_text", "text": "b"}]}], "usage": {"input_tokens": 5, "output_tokens": 1, "total_tokens": 9}}
    cases = [
        (chat, 200, "hi", True, None), (typed, 200, "ab", True, None), ({"choices": [{"text": "t"}]}, 200, "t", True, None), ({"output_text": "o"}, 200, "o", True, None),
        ({"choices": [{"finish_reason": "length", "message": {"content": "cut"}}]}, 200, "cut", False, "incomplete_model_output"), ({"status": "incomplete", "output_text": "o"}, 200, "o", False, "incomplete_model_output"),
        ({"error": {"message": "busy"}}, 503, "", False, "busy"), ({"error": {"type": "limit"}}, 429, "", False, "limit"), ({"error": {}}, 500, "", False, "api_error"), ({"error": "plain"}, 500, "", False, "plain"), ({"message": "m"}, 500, "", False, "m"),
        (chat, 503, "hi", False, "empty_content"), ({"choices": [{"finish_reason": None, "message": {"content": "n"}}]}, 200, "n", True, None), ({}, 200, "", False, "empty_content"), ([1], 200, "", False, "incomplete_model_output"),
    ]
    frame = spark.createDataFrame([(i, json.dumps(c[0]), c[1], i % 2 == 1) for i, c in enumerate(cases)], "i int, raw string, status_code int, cached boolean")
    got = [(r.content, r.ok, r.error) for r in sorted(responses.usable(frame).collect())]
    assert got == [c[2:] for c in cases]
    assert responses.token_usage(frame.where("i < 2")).first().asDict() == {"calls": 1, "prompt_tokens": 3, "completion_tokens": 2, "total_tokens": 5}
    assert responses.token_usage(frame.withColumn("cached", F.lit(False)).where("i = 1")).first().total_tokens == 9


def test_json_in_answers(spark):
    cases = [
        ('{"a":1}', None), ('<think>x {"b":2}</think>\n{"a":1}', None), ("<think>never closed {", "unfinished thinking block"), ('```json\n{"a":1}\n```', None), ('Sure: {"a":1} done.', None), ("[1,2]", "root is no object"), ("nothing", "no JSON"), ('} {', "no JSON"), ("", "no JSON"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").withColumn("j", responses.json_object(F.col("t")))
    got = sorted(rows.select("i", "j.error", F.try_variant_get("j.value", "$.a", "int").alias("a")).collect())
    assert [r.error for r in got] == [c[1] for c in cases]
    assert [r.a for r in got] == [1 if c[1] is None else None for c in cases]
