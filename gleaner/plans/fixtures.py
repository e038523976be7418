"""Views on the driver's tables that stand in for passage groups, cards and verdicts.

A document plays the article, its lines the passages, every five lines a group,
its source the subject; defects that the tables lack are put in by modulus. The text of a view is the
same in Spark and DuckDB, but for the one that splits documents into lines.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.records import CARD_FLAGS, SELF_CHECK_FLAGS
from gleaner.operators import checks

LINES_SPARK = r"select doc_id, cast(n as bigint) as n, line, lang, source from {documents} lateral view posexplode(split(text, '\n')) x as n, line"
LINES_DUCKDB = "select doc_id, unnest(generate_series(0, len(string_split(text, chr(10)))-1)) as n, unnest(string_split(text, chr(10))) as line, lang, source from documents"

VIEWS = {
    "fx_passages": """select doc_id, n, cast(floor(n / 5) as bigint) as part, n - 5 * cast(floor(n / 5) as bigint) as pos, concat('g', doc_id, '_', cast(floor(n / 5) as bigint)) as group_id,
  doc_id * 100000 + cast(floor(n / 5) as bigint) as group_order, concat('doc:', doc_id, '#', n) as source_id, concat(doc_id, '#', n) as passage_id, source as subject, lang,
  case when (doc_id*31+n)%97=3 then concat('Doc ', doc_id, ' (Disambiguation)') else concat('Doc ', doc_id) end as title,
  case (doc_id*31+n)%97
    when 1 then concat(line, ' Sorting them has a cost of , whatever their order was.')
    when 2 then concat(line, '�')
    when 4 then concat(line, ' To compute the density when the volume is known, divide the mass by it; this requires a volume that is not zero.')
    when 5 then concat(line, repeat(' x', 6001))
    when 6 then 'Density is the mass of a body divided by its volume, and the total mass of several bodies is the sum of theirs.'
    else line end as text from fx_lines""",
    "fx_groups": "select group_id, group_order, doc_id, subject, lang, pos, source_id, passage_id, title, text from fx_passages",
    "fx_citations": """select group_id, 'application' as stage, pos as cite_ix, case when group_order%11=0 then 'doc:other' else source_id end as source_id, passage_id,
  case when group_order%13=0 then concat(substr(text,1,40),' (invented)') else substr(text, 1+cast(group_order%7 as int), 40) end as quote from fx_passages""",
    "fx_cards": """select group_id, group_order, pos as card_index, lang as subject, substr(text,1,20) as concept_name, text as definition,
  group_order%3 as n_trigger, 1+group_order%2 as n_decision, group_order%2 as n_pitfall from fx_passages where pos < (doc_id + part) % 6""",
    "fx_judgments": """select group_id, 'card_review' as stage, card_index, (group_order+card_index)%5<>0 as source_supported, (group_order*3+card_index)%7<>0 as reusable,
  case when (group_order+2*card_index)%9=0 then 1 else 0 end as n_issues from fx_cards where not (group_order%17=0 and card_index=0)""",
    "fx_repairs": """select /*+ merge(j) */ c.group_id, c.card_index, case when c.group_order%2=0 then concat(c.definition,' (positive)') end as replacement_definition
  from fx_cards c join fx_judgments j on c.group_id=j.group_id and c.card_index=j.card_index where not (j.source_supported and j.reusable and j.n_issues=0)""",
    "fx_lines_json": """select group_id, concat('{"group_id":"', group_id, '"', case when group_order%29=1 then ',"extra":1' else '' end,
  ',"subject":', case when group_order%29=2 then '5' when group_order%29=3 then '"  "' else concat('"', subject, '"') end,
  case when group_order%29=4 then '' else concat(',"corpus":"', case when group_order%29=5 then 'other' else 'documents' end, '"') end,
  ',"language":', case when group_order%29=6 then 'null' else concat('"', lang, '"') end,
  ',"passages":', case when group_order%29=7 then '[]' when group_order%29=8 then '[{"source_id":"a","passage_id":"b","text":"c"},{"source_id":"a","passage_id":"d","text":7}]'
    when group_order%29=9 then '[{"source_id":"a","passage_id":"b","text":"c"},{"source_id":"a","passage_id":"b","text":"d"}]' else passages end,
  case when group_order%29=10 then '' else '}' end) as value from fx_passage_json""",
}
JSON_SPARK = "select group_id, group_order, max(subject) as subject, max(lang) as lang, to_json(transform(array_sort(collect_list(struct(n, source_id, passage_id, title, text))), x -> struct(x.source_id, x.passage_id, x.title, x.text))) as passages from fx_passages group by group_id, group_order"
JSON_DUCKDB = "select group_id, group_order, max(subject) as subject, max(lang) as lang, cast(to_json(list(struct_pack(source_id := source_id, passage_id := passage_id, title := title, text := text) order by n)) as varchar) as passages from fx_passages group by group_id, group_order"


def with_views(spark_sql: bool) -> str:
    """The WITH clause that both engines read."""
    parts = [("fx_lines", LINES_SPARK if spark_sql else LINES_DUCKDB)]
    for name, sql in VIEWS.items():
        if name == "fx_lines_json":
            parts.append(("fx_passage_json", JSON_SPARK if spark_sql else JSON_DUCKDB))
        parts.append((name, sql.replace("{", "{{").replace("}", "}}") if spark_sql else sql))
    return "with " + ",\n".join(f"{n} as ({s})" for n, s in parts) + "\n"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(with_views(True) + f"select * from {name}", documents=documents)


def view_on(passages: DataFrame, name: str) -> DataFrame:
    """A view over a table of fx_passages' rows, so that documents are split once for all views."""
    parts = [(n, sql.replace("{", "{{").replace("}", "}}").replace("fx_passages", "{fx_passages}")) for n, sql in VIEWS.items() if n not in ("fx_passages", "fx_lines_json")]
    return passages.sparkSession.sql("with " + ",\n".join(f"{n} as ({sql})" for n, sql in parts) + f"\nselect * from {name}", fx_passages=passages)


def echo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stands in for a model: the digest of what it is asked; every seventh call by its digest finds the service busy."""
    for batch in batches:
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in batch["body"]]
        raw = [json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": d}}]}) for d in digests]
        yield pd.DataFrame({"call_sha256": batch["call_sha256"], "status_code": [503 if int(c[:8], 16) % 7 == 0 else 200 for c in batch["call_sha256"]], "raw": raw, "latency_s": 0.0})


#: Arrays of a card, from the counts in fx_cards (DuckDB).
CARD_DUCKDB = """select *, list_transform(range(0, n_trigger), lambda i: concat('when ', i, ' ', concept_name)) as trigger,
  list_transform(range(0, n_decision), lambda i: concat('do ', i)) as decision, list_transform(range(0, n_pitfall), lambda i: concat('not ', i)) as pitfall from fx_cards"""
CARD_SPARK = """select *, transform(if(n_trigger > 0, sequence(0, cast(n_trigger as int) - 1), cast(array() as array<int>)), i -> concat('when ', i, ' ', concept_name)) as trigger,
  transform(if(n_decision > 0, sequence(0, cast(n_decision as int) - 1), cast(array() as array<int>)), i -> concat('do ', i)) as decision,
  transform(if(n_pitfall > 0, sequence(0, cast(n_pitfall as int) - 1), cast(array() as array<int>)), i -> concat('not ', i)) as pitfall from fx_cards"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_cards with the struct column card."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = spark.sql(with_views(True) + CARD_SPARK, documents=documents)
    return rows.selectExpr("*", "struct(concept_name, definition, trigger, decision, pitfall) as card")


ANSWERS = """select group_id, stage, attempt, if(attempt = 1 and stage = 'solution' and k % 11 = 3, 503, 200) as status_code, 0.0D as latency_s,
  to_json(named_struct('model', 'collected', 'choices', array(named_struct('finish_reason', 'stop', 'message', named_struct('content', if(k % 4 = 1, concat('```json\n', payload, '\n```'), payload)))),
    'usage', named_struct('prompt_tokens', 100 + k % 10, 'completion_tokens', length(payload)))) as raw
from (select group_id, k, stage, explode(if(stage = 'solution' and k % 11 = 3, array(1, 2), array(1))) as attempt, payload from {payloads})"""


def collected_answers(prepared: DataFrame) -> DataFrame:
    """Answers to every stage of prepared(group_id, group_order, passages), which follow from group_order: some groups fail, some are refused, some cards rejected, repaired or dropped."""
    p = F.get("passages", F.lit(0))
    rows = prepared.select("group_id", F.col("group_order").alias("k"), p["source_id"].alias("s"), p["passage_id"].alias("i"), p["text"].alias("t"))
    k, n = F.col("k"), (F.col("k") % 4).cast("int")
    named = lambda **f: F.struct(*[v.alias(x) for x, v in f.items()])
    cite = lambda quote: F.array(named(source_id=F.col("s"), passage_id=F.col("i"), quote=quote))
    proof, none, yes = cite(F.substring("t", 1, 40)), F.expr(checks.NONE), F.lit(True)
    each = lambda count, f: F.transform(F.slice(F.array(*[F.lit(x) for x in range(3)]), F.lit(1), count), f)

    def card(i, note: str):
        places = [("concept_name", None), ("definition", None), ("trigger", 0), ("decision", 0)]
        all_ = F.array(*[named(field=F.lit(x), item_index=F.lit(j).cast("int"), evidence=proof, support_type=F.lit("direct"), rationale=F.lit("quoted")) for x, j in places])
        c = named(concept_name=F.concat(F.lit("case "), i.cast("string"), F.lit(" of "), F.col("i")), definition=F.concat(F.substring("t", 1, 80), F.lit(note)), trigger=F.array(F.lit("when it holds")), decision=F.array(F.lit("apply it")), pitfall=none)
        return named(card=c, grounding=F.slice(all_, F.lit(1), F.when((k % 17 == 5) & (F.lit(note) == ""), F.lit(3)).otherwise(F.lit(4))))

    def verdicts(count, m: int):
        return each(count, lambda i: named(card_index=i, **{f: (k + i) % m != 0 if f == "source_supported" else yes for f in CARD_FLAGS}, missing_steps=none, issues=none, evidence=proof))

    rejected = F.filter(each(n, lambda i: i), lambda i: (k + i) % 3 == 0)
    kept = F.when(k % 2 == 0, n - F.size(rejected)).otherwise(n)
    payloads = {
        "application": named(question=F.lit("What follows in this case?"), assumptions=none, evidence=F.when(k % 7 == 1, cite(F.lit("written nowhere"))).otherwise(proof)),
        "solution": named(answer=F.lit("This."), explanation=F.lit("As quoted."), evidence=proof),
        "self_check": named(**{f: (k % 5 != 2) if f == "requires_application" else yes for f in SELF_CHECK_FLAGS}, issues=F.when(k % 13 == 4, F.array(F.lit("vague"))).otherwise(none), evidence=proof),
        "extraction": named(cards=each(n, lambda i: card(i, ""))),
        "card_review": named(cards=verdicts(n, 3)),
        "card_repair": named(repairs=F.transform(rejected, lambda i: named(card_index=i, replacement=F.when(k % 2 != 0, card(i, " (repaired)")), reason=F.lit("review")))),
        "repair_review": named(cards=verdicts(kept, 5)),
    }
    stages = F.array(*[F.struct(F.lit(x).alias("stage"), F.to_json(v, {"ignoreNullFields": "false"}).alias("payload")) for x, v in payloads.items()])
    long = rows.select("group_id", "k", F.explode(stages).alias("x")).select("group_id", "k", "x.stage", "x.payload")
    return prepared.sparkSession.sql(ANSWERS, payloads=long)
