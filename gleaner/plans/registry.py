"""Registered queries on the driver's tables, and the same queries as SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import responses
from gleaner.functions.records import CARD_FLAGS, SELF_CHECK_FLAGS, STAGE_SPECS
from gleaner.functions.strict import first_problem, json_schema
from gleaner.functions.text import content_key, render_card, safe_name
from gleaner.operators import checks, export, intake, preparation, requests, retrieval
from gleaner.plans.build import Build, Collected, Options, candidate_errors, same_article, supplied
from gleaner.plans.fixtures import CARD_DUCKDB, cards, collected_answers, echo, view, view_on, with_views
from gleaner.sources import readers
from gleaner.sources.clustered import ClusteredCorpus
from gleaner.sources.scratch import new_folder
from gleaner.sources.writers import append_table, write_jsonl, write_table

PREFIX = "doc:"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
DUCK = with_views(False).rstrip()
CUES = {"usage": preparation.USAGE_CUES, "boundary": preparation.BOUNDARY_CUES}


def query(sql: str | None = None):
    """Register a query, with SQL that follows the views (or starts with WITH or SELECT of its own)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def on_views(body: str) -> str:
    """SQL on the views: body may add views of its own ("name as (...), ... select")."""
    body = body.strip()
    return f"{DUCK}\n{body}" if body.lower().startswith("select") else f"{DUCK},\n{body}"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# The parts of the preparation in SQL.
STRIPPED = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
FORMULA_SQL = ", ".join(
    f"case when regexp_matches({STRIPPED}, '{p}') then concat('missing_formula: ', regexp_extract({STRIPPED}, '{p}')) end" for p in preparation.LOST_FORMULA
)
ISSUES_SQL = f"""case when length(text) > 12000 then ['too_long'] else list_filter([case when length({STRIPPED}) < 80 then 'too_short' end,
  case when regexp_matches({STRIPPED}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{FFFD}}]') then 'damaged_encoding' end,
  case when contains(lower(title), '(disambiguation)') then 'disambiguation' end, {FORMULA_SQL}], lambda x: x is not null) end"""


def cue_sql(kind: str) -> str:
    words = r"regexp_split_to_array(lower(substr(text, 1, 12000)), '[^\p{L}\p{N}_]+')"
    return f"len(list_intersect(list_distinct({words}), {_list(CUES[kind])}))"


CANDIDATES_SQL = f"""
corpus as (select doc_id, passage_id, source_id, title, text, row_number() over (partition by doc_id order by passage_id) as n from fx_passages),
near as (select distinct g.group_id, c.source_id, c.passage_id, c.title, c.text from (select distinct group_id, doc_id from fx_groups) g join corpus c on c.doc_id = g.doc_id where c.n <= 64),
cand as (select group_id, source_id, passage_id, title, text, true as is_seed from fx_groups union all
  select group_id, source_id, passage_id, title, text, false from near where (group_id, passage_id) not in (select (group_id, passage_id) from fx_groups)),
scored as (select *, {ISSUES_SQL} as issues, {cue_sql('usage')} as usage_cues, {cue_sql('boundary')} as boundary_cues from cand),
ranked as (select *, row_number() over (partition by group_id order by case when is_seed then 0 else 1 end, -(usage_cues + 2*boundary_cues), passage_id, source_id) as rank from scored where len(issues) = 0)"""
SELECTED_SQL = (
    CANDIDATES_SQL
    + """,
lists as (select group_id, list(struct_pack(p := passage_id, t := text) order by rank) as xs from ranked group by group_id),
folded as (select group_id, xs, list_reduce(xs, lambda acc, x: case
   when list_contains(acc.kept, x.t) then struct_pack(kept := acc.kept, total := acc.total, notes := list_append(acc.notes, 'duplicate_text'))
   when len(acc.kept) >= 5 or acc.total + length(x.t) > 30000 then struct_pack(kept := acc.kept, total := acc.total, notes := list_append(acc.notes, 'evidence_budget'))
   else struct_pack(kept := list_append(acc.kept, x.t), total := acc.total + length(x.t), notes := list_append(acc.notes, 'selected')) end,
   struct_pack(kept := cast([] as varchar[]), total := cast(0 as bigint), notes := cast([] as varchar[]))) as f from lists),
notes as (select group_id, unnest(list_transform(xs, lambda x: x.p)) as passage_id, unnest(f.notes) as picked from folded),
sel as (select s.*, coalesce(n.picked = 'selected', false) as selected, case when n.picked <> 'selected' then n.picked end as note from scored s left join notes n using (group_id, passage_id))"""
)


def _seeds(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "fx_groups")


def _corpus(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "fx_passages").withColumn("article_id", F.col("doc_id").cast("string"))


def _passages(spark, sf_dir) -> DataFrame:
    """fx_passages with their scores, written once and dealt evenly: seeds, corpus and the other views come from one table."""
    return write_table(preparation.scored(view(spark, sf_dir, "fx_passages").hint("rebalance")), f"{new_folder(spark, 'passages')}/passages")


def _candidates(passages: DataFrame) -> DataFrame:
    return preparation.article_candidates(passages, passages.withColumn("article_id", F.col("doc_id").cast("string")), PREFIX, 64)


def _selected(passages: DataFrame) -> DataFrame:
    return preparation.selection(_candidates(passages))


@query(on_views(r"""j as (select group_id, try_cast(value as json) as v from fx_lines_json),
p as (select group_id, unnest(json_extract(v, '$.passages[*]')) as p from j where v is not null),
ptext as (select group_id, len(list_filter(json_keys(p), lambda k: k not in ('source_id', 'passage_id', 'title', 'text'))) = 0 and json_type(p, '$.source_id') = 'VARCHAR' and json_type(p, '$.passage_id') = 'VARCHAR' and json_type(p, '$.text') = 'VARCHAR'
   and coalesce(json_type(p, '$.title'), 'VARCHAR') = 'VARCHAR' as typed, p->>'$.source_id' as s, p->>'$.passage_id' as i, regexp_replace(regexp_replace(p->>'$.text', '^\s+', ''), '\s+$', '') as t from p),
pa as (select group_id, bool_and(coalesce(typed and trim(s) <> '' and trim(i) <> '' and length(t) between 1 and 12000, false)) as fine, sum(length(t)) as chars, count(*) as n, count(distinct concat(s, '|', i)) as k from ptext group by group_id)
select j.group_id, coalesce(list_sort(json_keys(v)) = ['corpus', 'group_id', 'language', 'passages', 'subject'] and json_type(v, '$.group_id') = 'VARCHAR' and json_type(v, '$.subject') = 'VARCHAR' and trim(v->>'$.subject') <> ''
   and v->>'$.corpus' = 'documents' and json_type(v, '$.language') = 'VARCHAR' and v->>'$.language' in ('en', 'de', 'fr', 'es') and json_type(v, '$.passages') = 'ARRAY' and pa.n between 1 and 5 and pa.fine and pa.chars <= 30000 and pa.k = pa.n, false) as valid
from j left join pa using (group_id)"""))
def intake_strictness(spark, sf_dir):
    """Strict reading of group JSON with every kind of defect: which lines are valid."""
    lines = view(spark, sf_dir, "fx_lines_json")
    return intake.parsed_groups(lines, ("documents",), ("en", "de", "fr", "es")).select("group_id", F.col("problem").isNull().alias("valid"))


@query(f"""with checked as ({ORACLE_SQL['intake_strictness']}),
given as (select distinct group_id, group_order, doc_id from ({on_views('select group_id, group_order, doc_id from fx_groups')})),
all_lines as (select doc_id % 7 as shard, group_order * 2 as place, group_id from given union all select doc_id % 7, group_order * 2 + 1, null from given where group_order % 5 = 0),
numbered as (select shard, group_id, row_number() over (partition by shard order by place) as line from all_lines)
select shard, line from numbered join checked using (group_id) where not valid""")
def refused_line_numbers(spark, sf_dir):
    """Group lines written as text files with blank lines between them, read back and checked: file and number of each refused line."""
    given = _seeds(spark, sf_dir).select("group_id", "group_order", (F.col("doc_id") % 7).alias("shard")).distinct()
    lines = view(spark, sf_dir, "fx_lines_json").join(given.hint("merge"), "group_id").select("shard", (F.col("group_order") * 2).alias("place"), "value")
    blank = given.where("group_order % 5 = 0").select("shard", (F.col("group_order") * 2 + 1).alias("place"), F.lit("").alias("value"))
    folder = f"{new_folder(spark, 'lines')}/groups"
    lines.unionByName(blank).repartition("shard").sortWithinPartitions("shard", "place").select("shard", "value").write.partitionBy("shard").text(folder)
    read = readers.read_lines(spark, folder)
    refused = intake.quarantine(intake.parsed_groups(read, ("documents",), ("en", "de", "fr", "es")))
    return readers.line_numbers(read, refused).select(F.regexp_extract("file", "shard=([0-9]+)", 1).cast("bigint").alias("shard"), F.col("line").cast("bigint").alias("line"))


@query(on_views(f"select source_id, array_to_string({ISSUES_SQL}, ',') as issues, len({ISSUES_SQL}) = 0 as usable from fx_passages"))
def passage_quality_flags(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_passages").withColumn("issues", preparation.quality_issues(F.col("text"), F.col("title")))
    return rows.select("source_id", F.array_join("issues", ",").alias("issues"), (F.size("issues") == 0).alias("usable"))


@query(on_views(f"select source_id, cast({cue_sql('usage')} as bigint) as usage_cues, cast({cue_sql('boundary')} as bigint) as boundary_cues from fx_passages"))
def passage_cue_scores(spark, sf_dir):
    text = F.col("text")
    return view(spark, sf_dir, "fx_passages").select(
        "source_id", preparation.cue_count(text, preparation.USAGE_CUES).cast("bigint").alias("usage_cues"), preparation.cue_count(text, preparation.BOUNDARY_CUES).cast("bigint").alias("boundary_cues")
    )


@query(on_views(CANDIDATES_SQL + """,
stats as (select doc_id, count(*) as available from fx_passages group by doc_id)
select c.group_id, c.passage_id, c.is_seed, s.available, least(s.available, 64) as fetched, s.available > 64 as truncated from cand c join stats s on s.doc_id = cast(string_split(c.passage_id, '#')[1] as bigint)"""))
def article_candidate_cap(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    found = preparation.article_candidates(_seeds(spark, sf_dir), corpus, PREFIX, 64)
    stats = preparation.article_stats(corpus, 64)
    return found.withColumn("article_id", F.split("passage_id", "#")[0]).join(stats.hint("merge"), "article_id").select("group_id", "passage_id", "is_seed", "available", "fetched", "truncated")


BROKEN_SEEDS = """select group_id, group_order, pos, case when group_order%23=0 then concat('doc:', passage_id, 'x') else source_id end as source_id,
  case when group_order%19=0 then concat('x', passage_id) when group_order%31=0 then concat(passage_id, '99999') else passage_id end as passage_id,
  case when group_order%29=0 then 'Other title' else title end as title, case when group_order%17=0 then concat(text, ' changed') else text end as text from fx_groups"""


@query(on_views(f"""seeds as (select * replace (case when group_order%31=0 and group_order%23<>0 and group_order%19<>0 then concat('doc:', passage_id) else source_id end as source_id) from ({BROKEN_SEEDS}))
select s.group_id, s.pos, case when not regexp_full_match(s.passage_id, '[0-9]+#[0-9]+') then 'passage_id is not article#passage'
  when s.source_id <> concat('doc:', s.passage_id) then 'source_id does not match the corpus prefix' when c.text is null then 'passage not found in the corpus'
  when c.text <> s.text or (s.title <> '' and c.title <> s.title) then 'passage differs from the corpus' else 'ok' end as result
from seeds s left join fx_passages c on c.passage_id = s.passage_id"""))
def seed_corpus_check(spark, sf_dir):
    seeds = spark.sql(BROKEN_SEEDS.replace("fx_groups", "{fx_groups}"), fx_groups=_seeds(spark, sf_dir))
    order = F.col("group_order")
    moved = (order % 31 == 0) & (order % 23 != 0) & (order % 19 != 0)
    seeds = seeds.withColumn("source_id", F.when(moved, F.concat(F.lit(PREFIX), "passage_id")).otherwise(F.col("source_id")))
    return preparation.seed_errors(seeds, _corpus(spark, sf_dir), PREFIX).select("group_id", "pos", F.coalesce("error", F.lit("ok")).alias("result"))


@query(on_views(CANDIDATES_SQL + """,
stats as (select doc_id, count(*) as available from fx_passages group by doc_id)
select c.group_id, c.passage_id, c.is_seed, len(c.issues) = 0 as usable, cast(c.usage_cues as bigint) as usage_cues, cast(length(c.text) as bigint) as length, s.available, s.available > 64 as truncated
from scored c join stats s on s.doc_id = cast(string_split(c.passage_id, '#')[1] as bigint)"""))
def clustered_candidates(spark, sf_dir):
    """The corpus laid out once in buckets, then candidates, scores and article sizes read from it without a shuffle of the corpus."""
    corpus = ClusteredCorpus.write(_corpus(spark, sf_dir), f"{new_folder(spark, 'clustered')}/corpus", 8)
    found = preparation.article_candidates(preparation.scored(_seeds(spark, sf_dir)), corpus, PREFIX, 64)
    stats = preparation.article_stats(corpus, 64)
    rows = found.withColumn("article_id", F.split("passage_id", "#")[0]).join(stats.hint("merge"), "article_id")
    return rows.select("group_id", "passage_id", "is_seed", "usable", F.col("usage_cues").cast("bigint").alias("usage_cues"), F.col("length").cast("bigint").alias("length"), "available", "truncated")


@query(on_views(CANDIDATES_SQL + " select group_id, passage_id, rank from ranked"))
def candidate_priority(spark, sf_dir):
    return preparation.ranked(_candidates(_passages(spark, sf_dir))).select("group_id", "passage_id", F.col("rank").cast("bigint").alias("rank"))


@query(on_views(SELECTED_SQL + " select group_id, passage_id, is_seed, selected, coalesce(note, '') as note from sel"))
def evidence_selection(spark, sf_dir):
    return _selected(_passages(spark, sf_dir)).select("group_id", "passage_id", "is_seed", "selected", F.coalesce("note", F.lit("")).alias("note"))


@query(on_views(SELECTED_SQL + """ select group_id, count(*) as candidates, count(*) filter (is_seed and len(issues) > 0) as filtered_seeds, count(*) filter (len(issues) > 0) as filtered_candidates,
  count(*) filter (selected) as selected_passages, count(*) filter (selected and not is_seed) as supplementary_passages from sel group by group_id"""))
def preparation_summary(spark, sf_dir):
    return preparation.preparation_summary(_selected(_passages(spark, sf_dir)))


@query(on_views(SELECTED_SQL.replace("where c.n <= 64", "where false") + " select group_id, passage_id, selected, coalesce(note, '') as note from sel"))
def supplied_selection(spark, sf_dir):
    """The mode without a corpus: the given passages alone are scored and selected."""
    seeds = _seeds(spark, sf_dir).select("group_id", "pos", "source_id", "passage_id", "title", "text")
    return supplied(preparation.Limits())(seeds).select("group_id", "passage_id", "selected", F.coalesce("note", F.lit("")).alias("note"))


@query(on_views("""faults as (select group_id, concat('seed is not among the candidates: ', passage_id) as error from fx_groups where group_order % 13 = 0 and pos = 0
  union all select group_id, concat('repeated candidate: ', passage_id) from fx_groups where group_order % 11 = 0 and pos = 1)
select group_id, min(error) as error from faults group by group_id"""))
def candidate_faults(spark, sf_dir):
    """Groups whose candidates lack a seed or hold one twice."""
    seeds = _seeds(spark, sf_dir)
    found = preparation.supplied_candidates(seeds.where("not (group_order % 13 = 0 and pos = 0)")).unionByName(preparation.supplied_candidates(seeds.where("group_order % 11 = 0 and pos = 1")))
    return candidate_errors(seeds, found)


VIOLATING = """select group_id, 0 as group_row, pos, source_id, passage_id, text from fx_groups
  union all select group_id, 0, pos + 10, source_id, passage_id, text from fx_groups where group_order%37=0
  union all select group_id, 1, pos, source_id, passage_id, text from fx_groups where group_order%43=0
  union all select concat(group_id, 'b'), 0, pos, source_id, passage_id, concat(text, ' edited') from fx_groups where group_order%41=0
  union all select group_id, 0, pos + 20 + k.k, concat(source_id, '/', k.k), passage_id, repeat('words ', 2500) from fx_groups cross join (select 1 as k union all select 2) k where group_order%47=0"""


@query(on_views(f"""p as ({VIOLATING}),
totals as (select group_id, group_row, sum(length(text)) as chars, count(*) as n from p group by all)
select 'duplicate group_id' as violation, group_id as key from p group by group_id having count(distinct group_row) > 1
union all select distinct 'duplicate passage in group', concat(group_id, '|', source_id, '|', passage_id) from (select group_id, source_id, passage_id from p group by group_id, group_row, source_id, passage_id having count(*) > 1)
union all select 'conflicting texts', concat(source_id, '|', passage_id) from p group by source_id, passage_id having count(distinct text) > 1
union all select distinct 'too many characters', group_id from totals where chars > 30000
union all select distinct 'too many passages', group_id from totals where n > 5
union all select distinct 'passage too long', concat(group_id, '|', source_id, '|', passage_id) from p where length({STRIPPED}) > 12000
union all select distinct 'blank text', concat(group_id, '|', source_id, '|', passage_id) from p where length({STRIPPED}) = 0"""))
def group_violations(spark, sf_dir):
    rows = spark.sql(VIOLATING.replace("fx_groups", "{fx_groups}"), fx_groups=_seeds(spark, sf_dir))
    return intake.group_violations(rows)


CITED = "c.group_id, c.cite_ix, coalesce(contains(p.text, c.quote), false) as ok"


@query(on_views(f"""select {CITED}, case when coalesce(contains(p.text, c.quote), false) then '' else concat('no exact quotation: source_id=', c.source_id, ', passage_id=', c.passage_id, ', quote=', substr(c.quote, 1, 240)) end as error
from fx_citations c left join fx_groups p on p.group_id = c.group_id and p.source_id = c.source_id and p.passage_id = c.passage_id"""))
def citation_check(spark, sf_dir):
    found = checks.citation_check(view(spark, sf_dir, "fx_citations"), _seeds(spark, sf_dir))
    return found.select("group_id", "cite_ix", "ok", F.coalesce("error", F.lit("")).alias("error"))


LABELS_SQL = f"""c as ({CARD_DUCKDB}),
e as (select *, list_concat(['concept_name[null]', 'definition[null]'], list_transform(range(0, n_trigger), lambda i: concat('trigger[', i, ']')), list_transform(range(0, n_decision), lambda i: concat('decision[', i, ']')),
   list_transform(range(0, n_pitfall), lambda i: concat('pitfall[', i, ']'))) as expected from c),
a as (select *, list_concat(list_filter(expected, lambda x: not (group_order%7=0 and x = 'definition[null]')), case when group_order%5=0 then ['trigger[0]', 'trigger[0]'] else [] end, case when group_order%11=0 then [concat('pitfall[', n_pitfall, ']')] else [] end) as actual from e)"""


@query(on_views(LABELS_SQL + """ select group_id, card_index, array_to_string(list_sort(list_filter(expected, lambda x: not list_contains(actual, x))), ',') as missing,
  array_to_string(list_sort(list_distinct(list_filter(actual, lambda x: not list_contains(expected, x)))), ',') as extra,
  array_to_string(list_sort(list_distinct(list_filter(actual, lambda x: len(list_filter(actual, lambda y: y = x)) > 1))), ',') as repeated from a"""))
def grounding_coverage(spark, sf_dir):
    rows = cards(spark, sf_dir)
    order = F.col("group_order")
    none = F.expr(checks.NONE)
    expected = checks.expected_labels(F.col("card"))
    actual = F.concat(
        F.filter(expected, lambda x: ~((order % 7 == 0) & (x == "definition[null]"))), F.when(order % 5 == 0, F.array(F.lit("trigger[0]"), F.lit("trigger[0]"))).otherwise(none),
        F.when(order % 11 == 0, F.array(F.concat(F.lit("pitfall["), F.col("n_pitfall").cast("string"), F.lit("]")))).otherwise(none),
    )
    found = rows.withColumn("c", checks.coverage(F.col("card"), actual))
    return found.select("group_id", "card_index", *[F.array_join(f"c.{x}", ",").alias(x) for x in ("missing", "extra", "repeated")])


@query(on_views("""n as (select group_id, count(*) as candidates from fx_cards group by group_id), j as (select group_id, list_sort(list(card_index)) as ix from fx_judgments group by group_id)
select group_id, coalesce(candidates, 0) as candidates, cast(coalesce(len(ix), 0) as bigint) as judged, coalesce(ix, []) = range(0, coalesce(candidates, 0)) as covered from n full join j using (group_id)"""))
def review_coverage(spark, sf_dir):
    return checks.review_coverage(view(spark, sf_dir, "fx_cards"), view(spark, sf_dir, "fx_judgments"))


def _gated(judgments: DataFrame) -> DataFrame:
    issues = F.when(F.col("n_issues") > 0, F.array(F.lit("issue"))).otherwise(F.expr(checks.NONE))
    return judgments.withColumn("accepted", checks.gate([F.col("source_supported"), F.col("reusable")], issues))


ACCEPTED = "(source_supported and reusable and n_issues = 0)"


@query(on_views(f"select group_id, count(*) as judged, count(*) filter {ACCEPTED.replace('(', '(where ', 1)} as passed, bool_or{ACCEPTED} as accepted from fx_judgments group by group_id"))
def card_gate(spark, sf_dir):
    return _gated(view(spark, sf_dir, "fx_judgments")).groupBy("group_id").agg(F.count("*").alias("judged"), F.count_if("accepted").alias("passed"), F.bool_or("accepted").alias("accepted"))


@query(on_views("""select distinct group_id, group_order%6<>0 and group_order%10<>0 and group_order%4<>0 as accepted from fx_groups"""))
def self_check_gate(spark, sf_dir):
    order = F.col("group_order")
    issues = F.when(order % 4 == 0, F.array(F.lit("issue"))).otherwise(F.expr(checks.NONE))
    return _seeds(spark, sf_dir).select("group_id", checks.gate([order % 6 != 0, order % 10 != 0], issues).alias("accepted")).distinct()


FLAGGED = ", ".join(f"case when k % 17 = {i} then null else (k // {2**i + 1}) % 9 <> 0 end as f{i}" for i in range(6))


@query(on_views(f"""n as (select group_id, card_index, (group_order * 7 + card_index * 13) % 2310 as k from fx_cards), f as (select *, {FLAGGED} from n)
select group_id, card_index, coalesce(f0 and f1 and f2 and f3 and f4 and f5, false) and k % 11 <> 0 and k % 7 <> 0 as card_accepted, coalesce(f0 and f1 and f2 and f3 and f4, false) and k % 7 <> 0 as check_passed from f"""))
def gates_of_all_flags(spark, sf_dir):
    """Verdicts on cards with every flag true, false or absent, missing steps and issues; and self checks alike."""
    k = F.col("k")
    rows = view(spark, sf_dir, "fx_cards").withColumn("k", (F.col("group_order") * 7 + F.col("card_index") * 13) % 2310)
    flags = [F.when(k % 17 == i, F.lit(None)).otherwise(F.call_function("div", k, F.lit(2**i + 1)) % 9 != 0) for i in range(6)]
    some = lambda n: F.when(k % n == 0, F.array(F.lit("one"))).otherwise(F.expr(checks.NONE))
    return rows.select("group_id", "card_index", checks.gate(flags[: len(CARD_FLAGS)], some(7), some(11)).alias("card_accepted"), checks.gate(flags[: len(SELF_CHECK_FLAGS)], some(7)).alias("check_passed"))


REPAIRED_SQL = """fixed as (select c.*, r.group_id is not null as named, r.replacement_definition from fx_cards c left join fx_repairs r on r.group_id = c.group_id and r.card_index = c.card_index),
revised as (select group_id, group_order, card_index as original_index, case when named then replacement_definition else definition end as definition from fixed),
kept as (select group_id, group_order, original_index, definition, row_number() over (partition by group_id order by original_index) - 1 as card_index from revised where definition is not null)"""


def _repaired(cards_: DataFrame, repairs: DataFrame) -> DataFrame:
    return checks.repaired(cards_, repairs.withColumnRenamed("replacement_definition", "definition"), "definition")


@query(on_views(REPAIRED_SQL + " select group_id, original_index, card_index, definition from kept"))
def repair_merge(spark, sf_dir):
    return _repaired(view(spark, sf_dir, "fx_cards"), view(spark, sf_dir, "fx_repairs")).select("group_id", "original_index", F.col("card_index").cast("bigint").alias("card_index"), "definition")


@query(on_views(f"""bad as (select group_id, card_index from fx_judgments where not {ACCEPTED}), fix as (select group_id, card_index + case when hash_row then 1 else 0 end as card_index from (select *, substr(group_id, length(group_id)) = '7' as hash_row from fx_repairs)),
f as (select group_id, card_index, count(*) as n from fix group by all)
select group_id, card_index, case when f.n is null then 'no repair' when b.x is null then 'not rejected' else 'repaired twice' end as problem from (select *, 1 as x from bad) b full join f using (group_id, card_index) where f.n is null or b.x is null or f.n > 1"""))
def repair_cover(spark, sf_dir):
    shifted = view(spark, sf_dir, "fx_repairs").withColumn("card_index", F.col("card_index") + F.col("group_id").endswith("7").cast("bigint"))
    return checks.repair_mismatch(_gated(view(spark, sf_dir, "fx_judgments")).where("not accepted"), shifted)


@query(on_views(f"""select group_id, stage, card_index from fx_judgments where not {ACCEPTED}
union all select group_id, 'repair_review', card_index from fx_judgments where not {ACCEPTED} and card_index%2=0"""))
def card_rejections(spark, sf_dir):
    first = _gated(view(spark, sf_dir, "fx_judgments")).where("not accepted").select("group_id", "stage", "card_index")
    again = first.where("card_index % 2 = 0").withColumn("stage", F.lit("repair_review"))
    return first.unionByName(again)


@query(on_views(SELECTED_SQL + "," + REPAIRED_SQL + f""",
prep as (select group_id, bool_or(selected) as prepared from sel group by group_id),
chk as (select distinct group_id, group_order, group_order%6<>0 and group_order%10<>0 and group_order%4<>0 as ok from fx_groups),
n as (select group_id, count(*) as n from fx_cards group by group_id), k as (select group_id, count(*) as k from kept group by group_id),
rep as (select group_id, count(*) as r from fx_repairs group by group_id),
fin as (select k.group_id, bool_or((k.group_order+k.original_index)%3<>0) as ok from kept k group by k.group_id),
cites as (select c.group_id, bool_and(coalesce(contains(p.text, c.quote), false)) as ok from fx_citations c left join fx_groups p on p.group_id = c.group_id and p.source_id = c.source_id and p.passage_id = c.passage_id group by c.group_id)
select chk.group_id, case when not cites.ok then 'error' when not coalesce(prep.prepared, false) or not chk.ok or coalesce(n.n, 0) = 0 or (rep.r is not null and coalesce(k.k, 0) = 0) then 'rejected'
   when rep.r is not null then case when coalesce(fin.ok, false) then 'accepted' else 'rejected' end when coalesce(fin.ok, false) then 'accepted' else 'rejected' end as status,
  coalesce(case when not cites.ok then null when not coalesce(prep.prepared, false) then 'source_preparation' when not chk.ok then 'self_check' when coalesce(n.n, 0) = 0 then 'empty_extraction'
   when rep.r is not null and coalesce(k.k, 0) = 0 then 'card_repair' when coalesce(fin.ok, false) then null when rep.r is not null then 'repair_review' else 'card_review' end, '') as rejection_stage
from chk left join cites using (group_id) left join prep using (group_id) left join n using (group_id) left join k using (group_id) left join rep using (group_id) left join fin using (group_id)"""))
def group_outcomes(spark, sf_dir):
    passages = _passages(spark, sf_dir)
    return _outcomes(passages, _selected(passages)).select("group_id", "status", F.coalesce("rejection_stage", F.lit("")).alias("rejection_stage"))


def _outcomes(passages: DataFrame, selected: DataFrame) -> DataFrame:
    """Every group with its status, from what each stage left behind."""
    order = F.col("group_order")
    base = passages.select("group_id", ((order % 6 != 0) & (order % 10 != 0) & (order % 4 != 0)).alias("checked")).distinct()
    prep = selected.groupBy("group_id").agg(F.bool_or("selected").alias("prepared"))
    cards_, repairs = (view_on(passages, x) for x in ("fx_cards", "fx_repairs"))
    n = cards_.groupBy("group_id").agg(F.count("*").alias("n_cards"))
    kept = _repaired(cards_, repairs).groupBy("group_id").agg(F.count("*").alias("n_revised"), F.bool_or((order + F.col("original_index")) % 3 != 0).alias("final"))
    rep = repairs.groupBy("group_id").agg(F.lit(True).alias("with_repair"))
    bad = checks.citation_check(view_on(passages, "fx_citations"), passages).groupBy("group_id").agg(F.min("error").alias("error"))
    rows = base
    for part in (prep, n, kept, rep, bad):
        rows = rows.join(part.hint("merge"), "group_id", "left")
    found = export.outcome(F.col("prepared"), F.col("checked"), F.col("n_cards"), F.col("n_revised"), F.col("final"), F.coalesce("with_repair", F.lit(False)), F.col("error"))
    return rows.withColumn("o", found).select("group_id", "o.status", "o.rejection_stage", F.coalesce("with_repair", F.lit(False)).alias("with_repair"))


@query(on_views(f"""c as ({CARD_DUCKDB})
select group_id, card_index, array_to_string(list_concat([concat('Description: ', definition), 'Trigger:'], list_transform(trigger, lambda x: concat('- ', x)), ['Decision:'], list_transform(decision, lambda x: concat('- ', x)), ['Pitfall:'],
  list_transform(pitfall, lambda x: concat('- ', x))), chr(10)) as description from c"""))
def card_rendering(spark, sf_dir):
    return cards(spark, sf_dir).select("group_id", "card_index", render_card(F.col("card")).alias("description"))


@query(on_views(f"""c as ({CARD_DUCKDB})
select group_id, card_index, array_to_string(list_concat(['Trigger:'], list_transform(trigger, lambda x: concat('- ', x)), ['Decision:'], list_transform(decision, lambda x: concat('- ', x)), ['Pitfall:'],
  list_transform(pitfall, lambda x: concat('- ', x))), chr(10)) as without_definition, concat('Description: ', definition) as definition_only from c"""))
def field_ablation(spark, sf_dir):
    card = F.col("card")
    return cards(spark, sf_dir).select(
        "group_id", "card_index", render_card(card, ("trigger", "decision", "pitfall")).alias("without_definition"), render_card(card, ("definition",)).alias("definition_only")
    )


def json_text(x: str) -> str:
    return f"""concat('"', replace(replace({x}, '\\', '\\\\'), '"', '\\"'), '"')"""


def normal(x: str) -> str:
    return rf"trim(regexp_replace(nfc_normalize({x}), '[\s\x{{00A0}}\x1c-\x1f]+', ' ', 'g'))"


def json_list(x: str) -> str:
    return f"concat('[', array_to_string(list_transform({x}, lambda x: {json_text(normal('x'))}), ','), ']')"


BANK_SQL = f"""c as ({CARD_DUCKDB}),
ok as (select c.* from c join fx_judgments j on j.group_id = c.group_id and j.card_index = c.card_index where {ACCEPTED}),
keyed as (select *, sha256(concat('{{"card":{{"concept_name":', {json_text(normal('concept_name'))}, ',"decision":', {json_list('decision')}, ',"definition":', {json_text(normal('definition'))}, ',"pitfall":', {json_list('pitfall')},
   ',"trigger":', {json_list('trigger')}, '}},"subject":"', subject, '"}}')) as key from ok),
bank as (select concat('mem_', key) as memory_id, min(struct_pack(o := group_order, i := card_index)) as first, count(*) as n, array_to_string(list(concat(group_id, ':', card_index) order by group_order, card_index), ',') as origins from keyed group by key)"""


@query(on_views(BANK_SQL + " select memory_id, first.o as group_order, first.i as card_index, n as n_origins, origins, row_number() over (order by first.o, first.i) - 1 as \"index\" from bank"))
def bank_dedup(spark, sf_dir):
    judged = _gated(view(spark, sf_dir, "fx_judgments")).where("accepted").select("group_id", "card_index")
    accepted = cards(spark, sf_dir).join(judged.hint("merge"), ["group_id", "card_index"]).withColumn("origin", F.concat_ws(":", "group_id", "card_index"))
    accepted = write_table(export.keyed(accepted), f"{new_folder(spark, 'bank')}/accepted")
    rows = export.dense_index(export.bank(accepted), ["group_order", "card_index"])
    origins = export.lineage(accepted).groupBy("content_key").agg(F.array_sort(F.collect_list(F.struct("origin_no", "origin"))).alias("x"))
    rows = rows.join(origins.hint("merge"), "content_key").withColumn("origins", F.array_join(F.transform("x", lambda x: x["origin"]), ","))
    return rows.select("memory_id", "group_order", "card_index", "n_origins", "origins", F.col("index").cast("bigint").alias("index"))


@query(on_views(BANK_SQL + " select concat('mem_', key) as memory_id, row_number() over (partition by key order by group_order, card_index) as origin_no, group_id, card_index from keyed"))
def bank_lineage(spark, sf_dir):
    """Which accepted cards each card of the bank stands for: a row an origin, however many a card has."""
    judged = _gated(view(spark, sf_dir, "fx_judgments")).where("accepted").select("group_id", "card_index")
    accepted = cards(spark, sf_dir).join(judged.hint("merge"), ["group_id", "card_index"]).withColumn("origin", F.col("group_id"))
    accepted = write_table(export.keyed(accepted), f"{new_folder(spark, 'lineage')}/accepted")
    return export.lineage(accepted).select("memory_id", F.col("origin_no").cast("bigint").alias("origin_no"), F.col("origin").alias("group_id"), "card_index")


KEY_LISTS = {"joined": "[concat(concept_name, chr(31), 'y')]", "apart": "[concept_name, 'y']", "control": "[concat(concept_name, chr(7), 'y')]"}


def key_sql(trigger: str) -> str:
    """The content key of a card whose other lists are ['do'] and []."""
    items = f"concat('[', array_to_string(list_transform({trigger}, lambda x: replace({json_text(normal('x'))}, chr(7), '\\u0007')), ','), ']')"
    return f"""sha256(concat('{{"card":{{"concept_name":', {json_text(normal('concept_name'))}, ',"decision":["do"],"definition":', {json_text(normal('definition'))}, ',"pitfall":[],"trigger":', {items}, '}},"subject":"', subject, '"}}'))"""


@query(on_views("select group_id, card_index, " + ", ".join(f"{key_sql(x)} as {n}" for n, x in KEY_LISTS.items()) + " from fx_cards"))
def content_key_of_odd_texts(spark, sf_dir):
    """Keys of cards whose lists differ only in where one text ends and the next begins, and of texts with control characters."""
    name = F.col("concept_name")
    lists = {"joined": F.array(F.concat(name, F.lit("\x1fy"))), "apart": F.array(name, F.lit("y")), "control": F.array(F.concat(name, F.lit("\x07y")))}
    rows = view(spark, sf_dir, "fx_cards")
    key = lambda x: content_key(F.col("subject"), F.struct("concept_name", "definition", x.alias("trigger"), F.array(F.lit("do")).alias("decision"), F.expr(checks.NONE).alias("pitfall")))
    return rows.select("group_id", "card_index", *[key(x).alias(n) for n, x in lists.items()])


@query(on_views("""seen as (select distinct group_id, subject, group_order from fx_groups) select group_id, sha256(concat(group_id, '|', subject)) as request_sha256, case when group_order%3=0 then 'pending' when group_order%7=0 then 'pending' else 'done' end as state from seen"""))
def resume_pending(spark, sf_dir):
    """Two thirds of the groups have results, some of them with a wrong checksum: what has to run again."""
    seen = _seeds(spark, sf_dir).select("group_id", "subject", "group_order").distinct()
    asked = seen.withColumn("request_sha256", F.sha2(F.concat_ws("|", "group_id", "subject"), 256))
    payload = F.concat(F.lit('{"group":"'), "group_id", F.lit('"}'))
    done = asked.where("group_order % 3 <> 0").select("request_sha256", payload.alias("payload"), F.when(F.col("group_order") % 7 == 0, F.lit("0")).otherwise(F.sha2(payload, 256)).alias("payload_sha256"))
    todo = requests.pending(asked, done).select("group_id", "request_sha256", F.lit("pending").alias("state"))
    return todo.unionByName(requests.reusable(asked, done).select("group_id", "request_sha256", F.lit("done").alias("state")))


def _talk(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@query(r"""select conv_id, turn, 'm' as model, text as content, role, 6144 as max_tokens, 'none' as effort from conversations where text is not null and role is not null""")
def request_build(spark, sf_dir):
    """Bodies for one turn each, read back field by field."""
    turns = _talk(spark, sf_dir).where("text is not null and role is not null")
    messages = F.array(F.struct("role", F.col("text").alias("content")))
    body = F.parse_json(requests.request_body(messages, requests.ModelOptions(name="m")))
    get = lambda path, kind: F.try_variant_get(body, path, kind)
    return turns.select(
        "conv_id", "turn", get("$.model", "string").alias("model"), get("$.messages[0].content", "string").alias("content"), get("$.messages[0].role", "string").alias("role"),
        get("$.max_tokens", "int").alias("max_tokens"), get("$.reasoning_effort", "string").alias("effort"),
    )


@query(r"""select conv_id, turn, 'm' as model, text as content, role, 900 as max_tokens, 'low' as effort, false as store, 'json_schema' as format, 'solution' as format_name, 'object' as schema_type from conversations where text is not null and role is not null""")
def typed_request_build(spark, sf_dir):
    """Bodies of the other protocol, with a format that the service is asked to keep to, read back field by field."""
    turns = _talk(spark, sf_dir).where("text is not null and role is not null")
    options = requests.ModelOptions(name="m", endpoint="responses", reasoning_effort="low", max_tokens=900)
    schema = json.dumps(json_schema(STAGE_SPECS["solution"]))
    body = F.parse_json(requests.request_body(F.array(F.struct("role", F.col("text").alias("content"))), options, requests.format_of("solution", schema, options.endpoint)))
    get = lambda path, kind: F.try_variant_get(body, path, kind)
    return turns.select(
        "conv_id", "turn", get("$.model", "string").alias("model"), get("$.input[0].content", "string").alias("content"), get("$.input[0].role", "string").alias("role"), get("$.max_output_tokens", "int").alias("max_tokens"),
        get("$.reasoning.effort", "string").alias("effort"), get("$.store", "boolean").alias("store"), get("$.text.format.type", "string").alias("format"), get("$.text.format.name", "string").alias("format_name"), get("$.text.format.schema.type", "string").alias("schema_type"),
    )


RAW = """concat('{"model":"m",', case when (conv_id+turn)%11=0 then concat('"status":"incomplete","output_text":"cut"') when (conv_id+turn)%7=0 then concat('"output":[{"type":"message","content":[{"type":"output_text","text":"{\\"a\\":', turn, '}"}]}]')
  when (conv_id+turn)%5=0 then '"error":{"type":"busy"}' else concat('"choices":[{"finish_reason":', case when (conv_id+turn)%13=0 then '"length"' when (conv_id+turn)%3=0 then 'null' else '"stop"' end,
  ',"message":{"content":"', case (conv_id+turn)%4 when 0 then '<think>open' when 1 then '<think>x</think> ' when 2 then '```json ' else 'so: ' end, '{\\"a\\":', turn, '}', case (conv_id+turn)%4 when 2 then ' ```' when 3 then ' done' else '' end, '"}}]') end,
  ',"usage":{"prompt_tokens":', conv_id%50, ',"input_tokens":7,"completion_tokens":', turn, case when conv_id%4=0 then concat(',"total_tokens":', conv_id%50+turn+1) else '' end, '}}')"""


def _replies(spark, sf_dir) -> DataFrame:
    rows = _talk(spark, sf_dir).where("conv_id is not null and turn is not null")
    raw = RAW.replace("\\\\", "\\").replace("\\", "\\\\")
    return rows.selectExpr("conv_id", "turn", f"{raw} as raw", "case when (conv_id+turn)%17=0 then 503 else 200 end as status_code", "conv_id%6=0 as cached")


@query(r"""with t as (select conv_id, turn, conv_id + turn as k from conversations where conv_id is not null and turn is not null),
s as (select *, case when k%11=0 then 'cut' when k%7=0 then concat('{"a":', turn, '}') when k%5=0 then '' else concat(case k%4 when 0 then '<think>open' when 1 then '<think>x</think> ' when 2 then '```json ' else 'so: ' end, '{"a":', turn, '}', case k%4 when 2 then ' ```' when 3 then ' done' else '' end) end as content,
   k%11<>0 and (k%7=0 or k%5=0 or k%13<>0) as done, k%17=0 as down from t)
select conv_id, turn, content, not down and done and content <> '' as ok,
  coalesce(case when not down and done and content <> '' then null when not done then 'incomplete_model_output' when k%7<>0 and k%5=0 then 'busy' else 'empty_content' end, '') as error,
  coalesce(case when k%11=0 then 'no JSON' when k%7=0 then null when k%5=0 then 'no JSON' when k%4=0 then 'unfinished thinking block' end, '') as json_error,
  case when k%11=0 then null when k%7=0 then turn when k%5=0 or k%4=0 then null else turn end as a from s""")
def response_parse(spark, sf_dir):
    said = responses.usable(_replies(spark, sf_dir)).withColumn("j", responses.json_object(F.col("content")))
    return said.select(
        "conv_id", "turn", "content", "ok", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("j.error", F.lit("")).alias("json_error"), F.try_variant_get("j.value", "$.a", "bigint").alias("a")
    )


@query(r"""select count(*) as calls, cast(coalesce(sum(p), 0) as bigint) as prompt_tokens, cast(coalesce(sum(turn), 0) as bigint) as completion_tokens, cast(coalesce(sum(case when conv_id%4=0 then conv_id%50+turn+1 else p + turn end), 0) as bigint) as total_tokens
from (select *, case when conv_id%50=0 then 7 else conv_id%50 end as p from conversations where conv_id is not null and turn is not null and conv_id%6<>0)""")
def token_usage(spark, sf_dir):
    return responses.token_usage(_replies(spark, sf_dir))


@query(ORACLE_SQL["group_outcomes"].rsplit("\nselect chk.group_id", 1)[0] + ",\no as (select chk.group_id" + ORACLE_SQL["group_outcomes"].rsplit("\nselect chk.group_id", 1)[1] + f""")
select count(*) as groups, count(*) filter (status = 'accepted') as accepted_groups, count(*) filter (status = 'rejected') as rejected_groups, count(*) filter (status = 'error') as error_groups,
  (select count(distinct group_id) from fx_repairs) as groups_with_repair, (select count(*) from fx_judgments where not {ACCEPTED}) as rejected_card_reviews,
  cast((select coalesce(count(*) filter (is_seed and len(issues) > 0), 0) from sel) as bigint) as filtered_seed_passages, (select count(*) filter (selected and not is_seed) from sel) as supplementary_passages, count(*) filter (status = 'error') = 0 as complete from o""")
def run_summary(spark, sf_dir):
    passages = _passages(spark, sf_dir)
    # what outcomes and totals ask of a candidate, not its ids and digests
    selected = write_table(_selected(passages).select("group_id", "is_seed", "issues", "selected"), f"{new_folder(spark, 'selected')}/selected")
    o = _outcomes(passages, selected)
    totals = export.progress(o).select("groups", F.col("accepted").alias("accepted_groups"), F.col("rejected").alias("rejected_groups"), F.col("errors").alias("error_groups"))
    repairs = view_on(passages, "fx_repairs").agg(F.countDistinct("group_id").alias("groups_with_repair"))
    reviews = _gated(view_on(passages, "fx_judgments")).agg(F.count_if(~F.col("accepted")).alias("rejected_card_reviews"))
    prep = preparation.preparation_summary(selected).agg(F.coalesce(F.sum("filtered_seeds"), F.lit(0)).alias("filtered_seed_passages"), F.coalesce(F.sum("supplementary_passages"), F.lit(0)).alias("supplementary_passages"))
    one = F.lit(1).alias("one")
    out = totals.select("*", one)
    for part in (repairs, reviews, prep):
        out = out.join(part.select("*", one), "one")
    return out.withColumn("complete", F.col("error_groups") == 0).drop("one")


@query("""with q as (select vec_id, label, cast(embedding as double[]) as e from embeddings where vec_id % 100 = 0 and label is not null and embedding is not null),
c as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null),
s as (select q.vec_id as query_id, c.vec_id as card_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as cosine from q join c using (label))
select query_id, card_id, rank from (select *, row_number() over (partition by query_id order by cosine desc, card_id) as rank from s) where rank <= 5""")
def subject_topk(spark, sf_dir):
    """The stated queries (vec_id divisible by 100) against all cards of their subject."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null and embedding is not null")
    cards_ = rows.select(F.col("vec_id").alias("card_id"), F.col("label").alias("subject"), F.col("embedding").alias("vector"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("subject"), F.col("embedding").alias("vector"))
    return retrieval.nearest(asked, cards_, 5).select("query_id", "card_id", F.col("rank").cast("bigint").alias("rank"))


@query("""with q as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id % 100 = 0 and embedding is not null), c as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null),
s as (select q.vec_id as query_id, c.vec_id as card_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as cosine from q cross join c)
select query_id, card_id, rank from (select *, row_number() over (partition by query_id order by cosine desc, card_id) as rank from s) where rank <= 10""")
def global_topk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    cards_ = rows.select(F.col("vec_id").alias("card_id"), F.col("embedding").alias("vector"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("subject"), F.col("embedding").alias("vector"))
    return retrieval.nearest(asked, cards_.withColumn("subject", F.lit(None).cast("int")), 10, by_subject=False).select("query_id", "card_id", F.col("rank").cast("bigint").alias("rank"))


def _sixty_bits(x: str) -> str:
    return f"cast(concat('0x', substr(sha256({x}), 1, 15)) as bigint)"


@query(f"""with topk as ({ORACLE_SQL['subject_topk']}),
cards as (select label as subject, vec_id as card_id, row_number() over (partition by label order by vec_id) - 1 as number, count(*) over (partition by label) as size from embeddings where label is not null and embedding is not null and vec_id is not null),
found as (select t.*, c.subject, c.size, cast(ceil(0.6 * max(t.rank) over (partition by query_id)) as bigint) as swaps from topk t join cards c on c.card_id = t.query_id),
walks as (select query_id, subject, size, max(swaps) as swaps, list(card_id) as held, {_sixty_bits("concat('7|', query_id)")} % size as start, [{', '.join(map(str, retrieval.STRIDES))}][{_sixty_bits("concat('7|', query_id, '|stride')")} % {len(retrieval.STRIDES)} + 1] % size as stride from found group by query_id, subject, size),
steps as (select *, unnest(range(0, least(size, swaps + len(held)))) as step from walks),
met as (select s.query_id, s.step, s.swaps, c.card_id from steps s join cards c on c.subject = s.subject and c.number = (s.start + s.step * s.stride) % s.size where not list_contains(s.held, c.card_id)),
drawn as (select query_id, card_id, rank from (select *, row_number() over (partition by query_id order by step) as rank from met) where rank <= swaps)
select f.query_id, f.rank, coalesce(d.card_id, f.card_id) as card_id, d.card_id is not null as replaced from found f left join drawn d on d.query_id = f.query_id and d.rank = f.rank""")
def random_replacement(spark, sf_dir):
    """The nearest cards of the stated queries, three of five replaced by other cards of their subject, drawn without repetition."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null and embedding is not null")
    cards_ = rows.select(F.col("vec_id").alias("card_id"), F.col("label").alias("subject"))
    subjects = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("subject"))
    found = write_table(subject_topk(spark, sf_dir).join(subjects.hint("merge"), "query_id"), f"{new_folder(spark, 'found')}/found")
    return retrieval.replaced_at_random(found, cards_.where("card_id is not null"), 0.6, 7).select("query_id", F.col("rank").cast("bigint").alias("rank"), "card_id", "replaced")


@query("""select lang, source, count(*) as items, cast(sum(case when quality = toxic + 1 then 1 else 0 end) as bigint) as correct, sum(case when quality = toxic + 1 then 1 else 0 end) / count(*) as accuracy, cast(grouping(lang, source) as bigint) as grouping
from documents join labels using (doc_id) group by cube (lang, source)""")
def accuracy_rollup(spark, sf_dir):
    """Quality labels as answers, one more than the toxic label as the expected ones: a missing answer is wrong."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return retrieval.accuracy(rows.select("lang", "source", F.col("quality").alias("answer"), (F.col("toxic") + 1).alias("expected")), "lang", "source")


CORPUS_JSON = f"""concat('{{"id":', case when k = 3 then '7' else {json_text('passage_id')} end, ',"title":', {json_text('title')}, case when k = 5 then '' else concat(',"text":', case when k = 7 then '["no text"]' else {json_text('text')} end) end, ',"section":"s"', case when k = 9 then '' else '}}' end)"""


@query(on_views(f"""l as (select *, (doc_id * 31 + n) % 41 as k from fx_passages), j as (select *, {CORPUS_JSON} as line from l)
select source_id, case when k in (3, 5, 7, 9) then '' else sha256(text) end as text_sha256, case when k in (3, 5, 7, 9) then '' else sha256(concat(line, chr(10))) end as line_sha256,
  case k when 3 then 'no id' when 5 then 'text is no string' when 7 then 'text is no string' when 9 then 'no JSON' else '' end as problem from j"""))
def corpus_reading(spark, sf_dir):
    """Corpus lines with defects, written as text files and read as a corpus: hashes of lines and texts, and why lines are refused."""
    k = (F.col("doc_id") * 31 + F.col("n")) % 41
    rows = view(spark, sf_dir, "fx_passages").withColumn("k", k)
    inner = lambda c: F.expr(f"substring(to_json(struct({c} as x)), 6, length(to_json(struct({c} as x))) - 6)")
    line = F.concat(
        F.lit('{"id":'), F.when(F.col("k") == 3, F.lit("7")).otherwise(inner("passage_id")), F.lit(',"title":'), inner("title"),
        F.when(F.col("k") == 5, F.lit("")).otherwise(F.concat(F.lit(',"text":'), F.when(F.col("k") == 7, F.lit('["no text"]')).otherwise(inner("text")))), F.lit(',"section":"s"'), F.when(F.col("k") == 9, F.lit("")).otherwise(F.lit("}")),
    )
    folder = f"{new_folder(spark, 'corpus')}/shards"
    rows.select(line.alias("value")).write.text(folder)
    corpus, refused = readers.read_corpus(spark, folder)
    fine = corpus.select(F.concat(F.lit(PREFIX), "passage_id").alias("source_id"), "text_sha256", "line_sha256", F.lit("").alias("problem"))
    # a refused line names its passage only by what stands in it, so the lines are matched by their start
    starts = rows.where("k in (3, 5, 7, 9)").select("source_id", F.substring(line, 1, 240).alias("start"), F.row_number().over(Window.partitionBy(F.substring(line, 1, 240)).orderBy("source_id")).alias("nth"))
    found = refused.select("problem", "start", F.row_number().over(Window.partitionBy("start").orderBy("problem")).alias("nth")).join(starts.hint("merge"), ["start", "nth"])
    return fine.unionByName(found.select("source_id", F.lit("").alias("text_sha256"), F.lit("").alias("line_sha256"), "problem"))


@query(on_views("""select group_id, max(subject) as subject, count(*) as passages, cast(sum(length(text)) as bigint) as characters, sha256(string_agg(passage_id, ',' order by pos)) as ids from fx_groups group by group_id"""))
def groups_through_files(spark, sf_dir):
    """Groups written as JSON lines and read back."""
    passage = "struct<pos:bigint,source_id:string,passage_id:string,title:string,text:string>"
    groups = _seeds(spark, sf_dir).groupBy("group_id").agg(F.max("subject").alias("subject"), F.array_sort(F.collect_list(F.struct("pos", "source_id", "passage_id", "title", "text"))).alias("passages"))
    folder = f"{new_folder(spark, 'groups')}/groups"
    write_jsonl(groups, folder)
    back = readers.read_jsonl(spark, folder, f"group_id string, subject string, passages array<{passage}>")
    total = F.aggregate("passages", F.lit(0).cast("bigint"), lambda n, p: n + F.length(p["text"]))
    return back.select("group_id", "subject", F.size("passages").cast("bigint").alias("passages"), total.alias("characters"), F.sha2(F.array_join("passages.passage_id", ","), 256).alias("ids"))


@query(r"""with t as (select conv_id, turn, regexp_replace(concat('talk of ', role), '[^A-Za-z0-9_.-]+', '_', 'g') as ns, text, conv_id % 5 as k from conversations where conv_id is not null and turn is not null and text is not null and role is not null)
select conv_id, turn, concat(ns, '-', substr(sha256(concat(ns, chr(31), text)), 1, 32)) as cache_key, k not in (0, 2) as hit, case k when 1 then 1 when 3 then 2 when 4 then 1 when 2 then 1 else 0 end as stored_rows from t""")
def response_cache(spark, sf_dir):
    """An append-only table of responses: failed ones are kept beside later ones, and only usable ones answer a request again."""
    turns = _talk(spark, sf_dir).where("conv_id is not null and turn is not null and text is not null and role is not null").withColumn("k", F.col("conv_id") % 5)
    ns = safe_name(F.concat(F.lit("talk of "), "role"))
    asked = turns.select("conv_id", "turn", "k", F.concat_ws("/", "conv_id", "turn").alias("call_sha256"), requests.cache_key(ns, F.col("text")).alias("cache_key"))
    folder = f"{new_folder(spark, 'responses')}/responses"
    raw = F.lit('{"choices":[{"message":{"content":"said"}}]}')
    for attempt in (1, 2):
        some = asked.where("k in (1, 2, 3, 4)" if attempt == 1 else "k = 3")
        status = F.when((F.col("k") == 2) | ((F.col("k") == 3) & F.lit(attempt == 1)), 503).otherwise(200)
        append_table(some.select("call_sha256", status.alias("status_code"), raw.alias("raw"), F.lit(0.0).alias("latency_s")), folder)
    log = readers.stored(spark, folder, "call_sha256 string, status_code int, raw string, latency_s double")
    known = responses.usable(log).groupBy("call_sha256").agg(F.bool_or("ok").alias("hit"), F.count("*").alias("stored_rows"))
    out = asked.join(known.hint("merge"), "call_sha256", "left")
    return out.select("conv_id", "turn", "cache_key", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("stored_rows", F.lit(0).cast("bigint")).alias("stored_rows"))


@query(r"""with t as (select conv_id, turn, sha256(text) as said, sha256(concat(conv_id, '/', turn, '/', text)) as call_sha256 from conversations where conv_id is not null and turn is not null and text is not null),
b as (select *, cast(concat('0x', substr(call_sha256, 1, 8)) as bigint) % 7 = 0 as busy from t)
select conv_id, turn, said as content, not busy as ok, case when busy then 2 else 1 end as answers from b""")
def answers_kept(spark, sf_dir):
    """Turns asked through a model in waves, twice: the second round asks only what found the service busy, and each turn has one response."""
    turns = _talk(spark, sf_dir).where("conv_id is not null and turn is not null and text is not null")
    todo = turns.select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("group_id"), F.lit("echo").alias("stage"), F.lit(1).alias("attempt"), F.col("text").alias("body"))
    todo = write_table(todo.withColumn("call_sha256", F.sha2(F.concat_ws("/", "conv_id", "turn", "body"), 256)), f"{new_folder(spark, 'asked')}/calls")
    folder, options = f"{new_folder(spark, 'answers')}/run", Options(model=requests.ModelOptions(concurrency=8), calls_kept_together=64)
    for _ in range(2):
        said = Build(spark, folder, echo, options).call(todo.drop("conv_id", "turn"), "echo", 1)
    kept = spark.read.parquet(f"{folder}/responses").groupBy("call_sha256").agg(F.count("*").alias("answers"))
    out = responses.usable(said).join(kept.hint("merge"), "call_sha256").join(todo.select("conv_id", "turn", "call_sha256").hint("merge"), "call_sha256")
    return out.select("conv_id", "turn", "content", "ok", "answers")


def _message(role: str, x: str) -> str:
    return f"""concat('{{"role":"{role}","content":', {json_text(x)}, '}}')"""


@query(rf"""with t as (select conv_id, turn, replace(text, chr(10), ' ') as said, concat('turn ', turn, ' is wrong') as error from conversations where conv_id is not null and turn is not null and text is not null),
m as (select *, concat('[', {_message('system', "'judge'")}, ',', {_message('user', "'ask'")}, case when said <> '' then concat(',', {_message('assistant', 'said')}) else '' end, ',', {_message('user', "concat('That did not pass: ', error, '. Please send the whole JSON object again with this put right.')")}, ']') as messages from t)
select conv_id, turn, messages, sha256(concat('p', chr(31), 'solution', chr(31), messages)) as request_sha256 from m""")
def retry_requests(spark, sf_dir):
    """The messages of a second attempt, which carry the answer and what was wrong with it, and the hash of the request."""
    turns = _talk(spark, sf_dir).where("conv_id is not null and turn is not null and text is not null")
    first = F.array(requests.message("system", F.lit("judge")), requests.message("user", F.lit("ask")))
    error = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" is wrong"))
    rows = turns.select("conv_id", "turn", requests.with_retry(first, F.replace("text", F.lit("\n"), F.lit(" ")), error).alias("m"))
    return rows.select("conv_id", "turn", F.to_json("m").alias("messages"), requests.request_hash("p", "solution", F.col("m")).alias("request_sha256"))


@query(on_views("""g as (select group_id, list(text order by pos) as texts, max(title) as title from fx_groups group by group_id)
select group_id, substr(array_to_string(list_concat([title], list_transform(texts, lambda t: substr(t, 1, 1200))), chr(10)), 1, 4000) as shown from g"""))
def evidence_shown(spark, sf_dir):
    """What a prompt shows of a card and its passages, within both limits."""
    g = _seeds(spark, sf_dir).groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"), F.max("title").alias("title"))
    return g.select("group_id", retrieval.evidence_text(F.col("title"), F.col("texts")).alias("shown"))


WORDS_SQL = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> ''))"


@query(on_views(f"""q as (select group_id, text as query_text from fx_groups where pos = 0),
p as (select g.group_id, q.query_text, g.passage_id, g.text, g.pos + 1 as rank from fx_groups g join q using (group_id)),
s as (select *, len(list_intersect({WORDS_SQL.format('query_text')}, {WORDS_SQL.format('text')})) / greatest(len({WORDS_SQL.format('query_text')}), 1) as overlap from p),
r as (select *, row_number() over (partition by group_id order by overlap desc, rank, passage_id) as new_rank from s)
select group_id, passage_id, new_rank from r where new_rank <= 3"""))
def lexical_rerank(spark, sf_dir):
    """The passages of a group by the words that they share with its first one."""
    rows = _seeds(spark, sf_dir)
    first = rows.where("pos = 0").select(F.col("group_id").alias("query_id"), F.col("text").alias("query_text"))
    pairs = rows.select(F.col("group_id").alias("query_id"), F.col("passage_id").alias("card_id"), F.col("text").alias("card_text"), (F.col("pos") + 1).alias("rank")).join(first.hint("merge"), "query_id")
    return retrieval.lexical_rerank(pairs, 3).select(F.col("query_id").alias("group_id"), F.col("card_id").alias("passage_id"), F.col("new_rank").cast("bigint").alias("new_rank"))


PAYLOAD = """concat('{"cards":[', array_join(transform(if(n > 0, sequence(1, n), cast(array() as array<int>)), i -> concat('{"card":{"concept_name":"c","definition":"', if(k = 4, ' ', 'd'), '","trigger":[', if(k = 5, '', '"t"'), '],"decision":["e"],"pitfall":[]',
  if(k = 6, ',"more":1', ''), '},"grounding":[{"field":"', if(k = 7, 'title', 'definition'), '","item_index":', case k when 8 then '-1' when 9 then '0.5' when 10 then '"0"' else 'null' end, ',"evidence":[', if(k = 11, '', '{"source_id":"s","passage_id":"p","quote":"q"}'),
  '],"support_type":"', if(k = 12, 'guessed', 'derived'), '"', if(k = 13, '', ',"rationale":"r"'), '}]}')), ','), ']', if(k = 14, ',"cards":7', ''), '}')"""


@query(on_views("""g as (select distinct group_id, group_order % 15 as k, group_order % 5 as n from fx_groups) select group_id, (n <= 3 and (n = 0 or k not in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)) and k <> 14) as valid from g"""))
def payload_schemas(spark, sf_dir):
    """Extraction payloads with one defect each, checked against the stage's closed schema: bounds of lists, choices, indexes, blanks, unknown and missing keys."""
    rows = _seeds(spark, sf_dir).select("group_id", (F.col("group_order") % 15).alias("k"), (F.col("group_order") % 5).cast("int").alias("n")).distinct()
    return rows.select("group_id", first_problem(F.expr(PAYLOAD), STAGE_SPECS["extraction"]).isNull().alias("valid"))


@query(on_views(SELECTED_SQL + """,
g as (select group_id, max(group_order) as k, bool_or(selected) as prepared from sel join (select distinct group_id, group_order from fx_groups) using (group_id) group by group_id),
r as (select *, k%4 as n, list_filter(range(0, k%4), lambda i: (k + i)%3 = 0) as bad from g),
f as (select *, case when k%2 = 0 then n - len(bad) else n end as kept from r),
o as (select *, len(list_filter(range(0, kept), lambda j: (k + j)%5 <> 0)) as passed,
  case when not prepared then 'source_preparation' when k%7 = 1 then 'error' when k%5 = 2 or k%13 = 4 then 'self_check' when n > 0 and k%17 = 5 then 'error' when n = 0 then 'empty_extraction' when len(bad) > 0 and kept = 0 then 'card_repair' end as stop from f)
select group_id, case when stop = 'error' then 'error' when stop is not null or (len(bad) > 0 and passed = 0) then 'rejected' else 'accepted' end as status,
  coalesce(case when stop = 'error' then null when stop is not null then stop when len(bad) > 0 and passed = 0 then 'repair_review' end, '') as rejection_stage,
  cast(case when stop is not null then 0 when len(bad) = 0 then n else passed end as bigint) as n_cards, coalesce(stop = 'error', false) as failed from o"""))
def synthesis_end_to_end(spark, sf_dir):
    """All stages on every group, with collected answers: the outcome of each group and its cards in the bank."""
    folder, passages = new_folder(spark, "build"), _passages(spark, sf_dir)
    groups = spark.sql(
        """select group_id, first(group_order) as group_order, first(subject) as subject, 'documents' as corpus, 'en' as language,
        transform(array_sort(collect_list(struct(pos, source_id, passage_id, title, text))), x -> struct(x.source_id, x.passage_id, x.title, x.text)) as passages from {g} group by group_id""",
        g=passages,
    )
    limits = preparation.Limits()
    build = Build(spark, f"{folder}/run", Collected(collected_answers), Options(limits=limits), same_article(passages.withColumn("article_id", F.col("doc_id").cast("string")), PREFIX, limits))
    outcomes = build.run(build.laid_out(groups, "given_groups"))
    origins = build.origins().groupBy(F.col("origin.group_id").alias("group_id")).agg(F.count("*").alias("n_cards"))
    return outcomes.join(origins.hint("merge"), "group_id", "left").select(
        "group_id", "status", F.coalesce("rejection_stage", F.lit("")).alias("rejection_stage"), F.coalesce("n_cards", F.lit(0).cast("bigint")).alias("n_cards"), F.col("error").isNotNull().alias("failed")
    )
