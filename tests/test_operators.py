import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import checks, export, preparation, requests, retrieval
from gleaner.sources import readers, writers
from gleaner.sources.clustered import ClusteredCorpus


def passages(spark, rows):
    return spark.createDataFrame(rows, "group_id string, source_id string, passage_id string, title string, text string, is_seed boolean")


def test_quality_issues(spark):
    long = "This sentence is long enough to be kept, because it has more than eighty characters in it, and then some. "
    cases = [
        (long, "T", []), ("short", "T", ["too_short"]), (long + "�", "T", ["damaged_encoding"]), (long + "\x0bx", "T", ["damaged_encoding"]), (long + "\x0b", "T", []), (long + "\n\r\tx", "T", []), (long, "A (Disambiguation)", ["disambiguation"]),
        (long + "Sorting it comes at a cost of ; whatever is sorted", "T", ["missing_formula: cost of ;"]), (long + "here E = mc and the set ( ), which is empty", "T", []), ("x" * 12001, "A (disambiguation)", ["too_long"]), (" " * 90 + "a", None, ["too_short"]),
        (long + "the complexity , and if is positive", None, ["missing_formula: complexity ,", "missing_formula: if is positive"]),
    ]
    frame = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(cases)], "i int, text string, title string")
    got = sorted(frame.select("i", preparation.quality_issues(F.col("text"), F.coalesce("title", F.lit(""))).alias("x")).collect())
    assert [r.x for r in got] == [c[2] for c in cases]


def test_cues_are_whole_words(spark):
    row = spark.createDataFrame([("If éif IF when, Total; only UNLESS only_x", "x" * 12000 + " if")], "a string, b string").select(
        preparation.cue_count(F.col("a"), preparation.USAGE_CUES).alias("u"), preparation.cue_count(F.col("a"), preparation.BOUNDARY_CUES).alias("v"), preparation.cue_count(F.col("b"), preparation.USAGE_CUES).alias("late")
    ).first()
    assert (row.u, row.v, row.late) == (3, 2, 0)


def test_greedy_selection(spark):
    lengths = [12000, 12000, 7000, 5000]
    rows = [("g", "s", str(i), "", chr(97 + i) * n, True) for i, n in enumerate(lengths)]
    rows += [("h", "s", str(i), "", t, i == 9) for i, t in enumerate(["a" * 100, "b" * 100, "a" * 100, "c" * 100, "d" * 100, "e" * 100, "f" * 100, "short"])]
    rows += [("k", "s", "1", "", "x" * 12000, True), ("k", "s", "2", "", "y" * 12000, True), ("k", "s", "3", "", "z" * 6001, True), ("k", "s", "4", "", "z" * 6001, True), ("k", "s", "5", "", "w" * 90, True)]
    picked = preparation.selection(preparation.scored(passages(spark, rows)))
    got = {(r.group_id, r.passage_id): (r.selected, r.note) for r in picked.collect()}
    assert [got["g", str(i)] for i in range(4)] == [(True, None), (True, None), (False, "evidence_budget"), (True, None)]
    assert [got["h", str(i)] for i in range(8)] == [(True, None), (True, None), (False, "duplicate_text"), (True, None), (True, None), (True, None), (False, "evidence_budget"), (False, None)]
    # a copy of a skipped text is no duplicate
    assert [got["k", str(i)] for i in range(1, 6)] == [(True, None), (True, None), (False, "evidence_budget"), (False, "evidence_budget"), (True, None)]
    summary = {r.group_id: r for r in preparation.preparation_summary(picked).collect()}
    assert (summary["h"].candidates, summary["h"].filtered_candidates, summary["h"].selected_passages, summary["h"].supplementary_passages) == (8, 1, 5, 5)
    assert [p.passage_id for p in {r.group_id: r.passages for r in preparation.prepared_groups(picked, passages(spark, rows)).collect()}["g"]] == ["0", "1", "3"]


def test_priority(spark):
    text = "This one is a plain filler text that says nothing and goes on for more than eighty characters {}".format
    rows = [("g", "s", "12#9", "", text("x"), True), ("g", "s", "12#10", "", text("y"), False), ("g", "s", "12#2", "", text("z"), False), ("g", "s", "12#3", "", text("unless not"), False), ("g", "s", "12#4", "", text("if when sum"), False)]
    got = preparation.ranked(preparation.scored(passages(spark, rows))).orderBy("rank").collect()
    assert [r.passage_id for r in got] == ["12#9", "12#3", "12#4", "12#10", "12#2"]


def test_articles_are_capped_by_string_order(spark):
    corpus = spark.createDataFrame([(str(a), f"{a}#{i}", "", f"text {a} {i}") for a, n in ((1, 63), (2, 64), (3, 65)) for i in range(n)], "article_id string, passage_id string, title string, text string")
    seeds = spark.createDataFrame([("g", 0, "p:1#0", "1#0", "", "text 1 0"), ("h", 0, "p:3#64", "3#64", "", "text 3 64"), ("h", 1, "p:2#1", "2#1", "", "text 2 1")], "group_id string, pos int, source_id string, passage_id string, title string, text string")
    found = preparation.article_candidates(seeds, corpus, "p:", 64)
    ids = {g: sorted(r.passage_id for r in found.where(F.col("group_id") == g).collect()) for g in ("g", "h")}
    assert len(ids["g"]) == 63 and len(ids["h"]) == 64 + 64 + ("3#64" not in sorted(f"3#{i}" for i in range(65))[:64])
    assert {r.article_id: (r.available, r.fetched, r.truncated) for r in preparation.article_stats(corpus, 64).collect()} == {"1": (63, 63, False), "2": (64, 64, False), "3": (65, 64, True)}
    assert preparation.missing_seeds(seeds, found).count() == 0 and preparation.repeated_candidates(found).count() == 0
    broken = spark.createDataFrame([("g", 0, "p:x", "x", "", ""), ("g", 1, "q:1#1", "1#1", "", ""), ("g", 2, "p:9#9", "9#9", "", ""), ("g", 3, "p:1#1", "1#1", "", "other"), ("g", 4, "p:1#1", "1#1", "Title", "text 1 1"), ("g", 5, "p:1#1", "1#1", "", "text 1 1")], seeds.schema)
    errors = {r.pos: r.error for r in preparation.seed_errors(broken, corpus, "p:").collect()}
    assert errors[5] is None and errors[3] == errors[4] == "passage differs from the corpus" and len({errors[i] for i in range(4)}) == 4


def test_limits_are_checked():
    for bad in ({"passages": 0}, {"passages": 6}, {"candidates": 257}):
        with pytest.raises(ValueError):
            preparation.Limits(**bad)
    for bad in ({"retries": 3}, {"concurrency": 0}, {"concurrency": 33}, {"endpoint": "x"}, {"max_tokens": 0}):
        with pytest.raises(ValueError):
            requests.ModelOptions(**bad)


def test_citations(spark):
    known = passages(spark, [("g", "s", "1", "", "the exact words", True), ("h", "s", "2", "", "other words", True)])
    cites = spark.createDataFrame([(0, "g", "s", "1", "exact"), (1, "g", "s", "1", "Exact"), (2, "g", "s", "2", "other"), (3, "g", "z", "1", "exact"), (4, "h", "s", "2", "q" * 300)], "i int, group_id string, source_id string, passage_id string, quote string")
    out = {r.i: r for r in checks.citation_check(cites, known).collect()}
    assert [out[i].ok for i in range(5)] == [True, False, False, False, False]
    assert out[4].error.endswith("quote=" + "q" * 240) and out[0].error is None


def test_coverage(spark):
    card = F.struct(F.lit("n").alias("concept_name"), F.lit("d").alias("definition"), F.array(F.lit("t")).alias("trigger"), F.array(F.lit("a"), F.lit("b")).alias("decision"), F.expr("cast(array() as array<string>)").alias("pitfall"))
    cases = [
        (["concept_name[null]", "definition[null]", "trigger[0]", "decision[0]", "decision[1]"], ([], [], [])),
        (["concept_name[null]", "trigger[0]", "trigger[0]", "decision[1]", "decision[0]", "pitfall[0]"], (["definition[null]"], ["pitfall[0]"], ["trigger[0]"])),
        ([], (["concept_name[null]", "decision[0]", "decision[1]", "definition[null]", "trigger[0]"], [], [])),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, actual array<string>").withColumn("c", checks.coverage(card, F.col("actual")))
    assert [(r.c.missing, r.c.extra, r.c.repeated) for r in sorted(rows.collect(), key=lambda r: r.i)] == [c[1] for c in cases]
    assert sorted(spark.createDataFrame([([1, 0], 2), ([0, 0], 2), ([0, 2], 2), ([0], 2), ([], 0)], "x array<bigint>, n int").select(checks.covers(F.col("x"), F.col("n")).alias("ok")).toPandas().ok) == [False, False, False, True, True]


def test_repair_replaces_keeps_and_drops(spark):
    cards = spark.createDataFrame([("g", i, f"d{i}") for i in range(3)] + [("h", 0, "x")], "group_id string, card_index int, definition string")
    repairs = spark.createDataFrame([("g", 0, None), ("g", 2, "new")], "group_id string, card_index int, definition string")
    got = sorted((r.group_id, r.original_index, r.card_index, r.definition) for r in checks.repaired(cards, repairs, "definition").collect())
    assert got == [("g", 1, 0, "d1"), ("g", 2, 1, "new"), ("h", 0, 0, "x")]
    rejected = spark.createDataFrame([("g", 0), ("g", 1)], "group_id string, card_index int")
    assert {(r.card_index, r.problem) for r in checks.repair_mismatch(rejected, repairs).collect()} == {(1, "no repair"), (2, "not rejected")}


def test_bank_keeps_the_first_and_all_origins(spark):
    card = {"concept_name": "c", "definition": "d", "trigger": ["t"], "decision": ["e"], "pitfall": []}
    rows = [(2, 0, "s", card, "b"), (1, 1, "s", {**card, "definition": " d "}, "a"), (1, 0, "s", {**card, "trigger": ["u"]}, "c"), (3, 0, "other", card, "d")]
    cards = spark.createDataFrame(rows, "group_order bigint, card_index int, subject string, card struct<concept_name:string,definition:string,trigger:array<string>,decision:array<string>,pitfall:array<string>>, origin string")
    cards = export.keyed(cards)
    got = export.dense_index(export.bank(cards), ["group_order", "card_index"]).orderBy("index").collect()
    assert [(r["index"], r.n_origins, r.card.definition, r.subject) for r in got] == [(0, 1, "d", "s"), (1, 2, " d ", "s"), (2, 1, "d", "other")]
    key = {r.content_key: r["index"] for r in got}
    assert sorted((key[r.content_key], r.origin_no, r.origin) for r in export.lineage(cards).collect()) == [(0, 1, "c"), (1, 1, "a"), (1, 2, "b"), (2, 1, "d")]


def test_a_card_with_very_many_origins_is_no_single_task(spark):
    n = 200_000
    rows = spark.range(n).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).cast("string").alias("content_key"), F.col("id").alias("group_order"), F.lit(0).alias("card_index"), F.col("id").alias("origin"))
    rows = rows.withColumn("subject", F.lit("s")).withColumn("card", F.struct(F.lit("c").alias("concept_name"), F.lit("d").alias("definition"), *[F.array(F.lit("x")).alias(x) for x in ("trigger", "decision", "pitfall")]))
    # the frequent card, nearly all rows, lies in several partitions of what is numbered
    held = [r["count"] for r in rows.repartitionByRange(4, "content_key", "group_order", "card_index").groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) < n / 2
    hot = export.lineage(rows).where("content_key = '-1'")
    assert hot.agg(F.min("origin_no"), F.max("origin_no"), F.count_distinct("origin_no")).first() == (1, n - n // 50, n - n // 50)
    assert hot.orderBy("origin_no").select("origin").limit(3).collect() == [(1,), (2,), (3,)]
    assert export.bank(rows).where("content_key = '-1'").first().n_origins == n - n // 50


def plan_of(frame):
    """The plan before anything ran."""
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_a_clustered_corpus_is_not_shuffled(spark, tmp_path):
    words = ["using", "therefore", "unless", "ratio", "plain"]
    text = "This passage is long enough to be offered as evidence, since it goes on for some eighty letters, {} {}."
    corpus = spark.createDataFrame([(str(a), f"{a}#{k}", f"T{a}", text.format(words[(a + k) % 5], k) if k % 9 else "short") for a in range(30) for k in range(1 + 300 * (a == 7) + a % 6)], "article_id string, passage_id string, title string, text string")
    seeds = spark.createDataFrame([(f"g{i}", 0, f"c:{i % 30}#0", f"{i % 30}#0", "", "short") for i in range(60)] + [("odd", 0, "c:99#0", "99#0", "", "short"), ("edited", 0, "c:1#0", "1#0", "", "other")], "group_id string, pos int, source_id string, passage_id string, title string, text string")
    made = ClusteredCorpus.write(corpus, f"{tmp_path}/c", 4)
    for name in ("passages", "first", "articles"):
        spark.sql(f"drop table {made.name(name)}")
    clustered = ClusteredCorpus.open(spark, f"{tmp_path}/c/")
    limits = preparation.Limits()
    seeds = preparation.scored(seeds)
    with_plain, with_clustered = (preparation.article_candidates(seeds, c, "c:", 64) for c in (preparation.scored(corpus), clustered))
    assert sorted(map(str, with_clustered.collect())) == sorted(map(str, with_plain.select(*with_clustered.columns).collect()))
    errors = [preparation.seed_errors(seeds, c, "c:") for c in (corpus, clustered)]
    assert sorted(map(str, errors[0].collect())) == sorted(map(str, errors[1].collect())) and errors[1].where("error is not null").count() == 2
    assert sorted(preparation.article_stats(clustered, 64).collect()) == sorted(preparation.article_stats(corpus, 64).collect())
    chosen = [preparation.prepared_groups(preparation.selection(x, limits), seeds, c) for x, c in ((with_plain, corpus), (with_clustered, clustered))]
    assert sorted(map(str, chosen[0].collect())) == sorted(map(str, chosen[1].collect())) and chosen[1].count() > 20
    # no exchange stands over a scan of the corpus
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for frame in (preparation.seed_errors(seeds, clustered, "c:"), preparation.article_candidates(seeds, clustered, "c:", 64).where("not is_seed"), preparation.article_stats(clustered, 64)):
            lines = plan_of(frame).splitlines()
            for i, line in enumerate(lines):
                if clustered.name("")[:-1] in line and "Scan parquet" in line:
                    depth = len(line) - len(line.lstrip(" :+-"))
                    above = []
                    for other in reversed(lines[:i]):
                        if (d := len(other) - len(other.lstrip(" :+-"))) < depth:
                            above.append(other.strip(" :+-"))
                            depth = d
                    # from the scan up to the first join nothing is moved
                    first_join = next((k for k, x in enumerate(above) if "Join" in x), len(above))
                    assert not any("Exchange" in x for x in above[:first_join]), above
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    with pytest.raises(ValueError):
        clustered.first(257)
    with pytest.raises(Exception):
        ClusteredCorpus.write(corpus, f"{tmp_path}/c", 4)


def test_dense_index_over_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    assert export.dense_index(rows, ["k"]).where("k <> index").count() == 0


def test_request_bodies(spark):
    messages = F.array(requests.message("system", F.lit("s")), requests.message("user", F.lit("ü")))
    row = spark.range(1).select(
        requests.request_body(messages, requests.ModelOptions(name="m")).alias("chat"), requests.request_body(messages, requests.ModelOptions(name="m", endpoint="responses", reasoning_effort="low")).alias("typed"),
        requests.request_body(messages, requests.ModelOptions(name="m", reasoning_effort=None), F.struct(F.lit("json").alias("type"))).alias("plain"), requests.with_retry(messages, F.lit("bad"), F.lit("why")).alias("again"), requests.with_retry(messages, F.lit(None).cast("string"), F.lit("why")).alias("silent"),
    ).first()
    both = [{"role": "system", "content": "s"}, {"role": "user", "content": "ü"}]
    assert json.loads(row.chat) == {"model": "m", "messages": both, "max_tokens": 6144, "reasoning_effort": "none"}
    assert json.loads(row.typed) == {"model": "m", "input": both, "max_output_tokens": 6144, "store": False, "reasoning": {"effort": "low"}}
    assert json.loads(row.plain) == {"model": "m", "messages": both, "max_tokens": 6144, "response_format": {"type": "json"}}
    assert [m.role for m in row.again] == ["system", "user", "assistant", "user"] and "why" in row.again[3].content and len(row.silent) == 3


def test_retrieval(spark):
    cards = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(10)] + [(99, 0, [0.0, 0.0])], "card_id int, subject int, vector array<double>")
    asked = spark.createDataFrame([(1, 0, [1.0, 0.0])], "query_id int, subject int, vector array<double>")
    assert [r.card_id for r in retrieval.nearest(asked, cards, 3).orderBy("rank").collect()] == [8, 6, 4]
    found = retrieval.nearest(asked, cards, 4, by_subject=False).orderBy("rank")
    assert [r.card_id for r in found.collect()] == [9, 8, 7, 6]
    swapped = retrieval.replaced_at_random(found.withColumn("subject", F.lit(0)), cards, 0.5, seed=3).orderBy("rank").collect()
    assert [r.replaced for r in swapped] == [True, True, False, False] and [r.card_id for r in swapped[2:]] == [7, 6]
    pairs = spark.createDataFrame([(1, "red green blue", 5, "red", 1), (1, "red green blue", 6, "Blue, green!", 2), (1, "red green blue", 7, "none", 3)], "query_id int, query_text string, card_id int, card_text string, rank int")
    assert [r.card_id for r in retrieval.lexical_rerank(pairs, 2).orderBy("new_rank").collect()] == [6, 5]
    assert spark.range(1).select(retrieval.evidence_text(F.lit("c" * 10), F.array(F.lit("p" * 2000)), 1000).alias("t")).first().t == "c" * 10 + "\n" + "p" * 989
    answers = spark.createDataFrame([("m", "a", 1, 1), ("m", "b", None, 1), ("n", "a", 2, 1)], "model string, bench string, answer int, expected int")
    got = {(r.model, r.bench): (r.items, r.correct) for r in retrieval.accuracy(answers, "model", "bench").collect()}
    assert got[None, None] == (3, 1) and got["m", None] == (2, 1) and got["m", "b"] == (1, 0)


def plain_nearest(asked, cards, k, by_subject):
    """All pairs, sums from left to right."""
    dot = lambda a, b: sum((x * y for x, y in zip(a, b)), 0.0)
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out = []
    for q, s, v in asked:
        near = [(-dot(v, w) / (dot(v, v) ** 0.5 * dot(w, w) ** 0.5), c) for c, t, w in cards if c is not None and fine(v) and fine(w) and len(v) == len(w) and (not by_subject or (s is not None and s == t))]
        out += [(q, c, i) for i, (_, c) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("by_subject", [True, False])
def test_nearest_of_odd_vectors_ties_and_many_tasks(spark, by_subject):
    rng = np.random.default_rng(4)
    few = rng.integers(-2, 3, (40, 6)).astype(float).tolist()
    cards = [(i, "hot" if i % 3 else f"s{i % 5}", few[int(rng.integers(40))]) for i in range(900)] + [(900, "hot", None), (901, "hot", [0.0] * 6), (902, "hot", [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, "hot", [float("nan")] * 6), (904, None, few[0]), (905, "hot", [1.0, 2.0]), (None, "hot", few[0])]
    asked = [(f"q{i}", s, v) for i, (s, v) in enumerate([("hot", few[0]), ("hot", few[1]), ("s0", few[2]), (None, few[3]), ("hot", None), ("hot", [2.0, 1.0]), ("none", few[4])])]
    q, c = spark.createDataFrame(asked, "query_id string, subject string, vector array<double>"), spark.createDataFrame(cards, "card_id bigint, subject string, vector array<double>")
    wanted = plain_nearest(asked, cards, 4, by_subject)
    for at_once in (1 << 20, 100):  # one pass, several passes
        got = retrieval.nearest(q, c.repartition(7), 4, by_subject, at_once)
        assert sorted((r.query_id, r.card_id, r["rank"]) for r in got.collect()) == wanted
    assert retrieval.nearest(q.limit(0), c, 4, by_subject).count() == retrieval.nearest(q, c.limit(0), 4, by_subject).count() == 0


def test_draws_repeat_nothing(spark):
    cards = spark.createDataFrame([(i, "big") for i in range(500)] + [(1000 + i, "small") for i in range(4)] + [(2000, "one")], "card_id bigint, subject string")
    rows = [(q, "big", r, (37 * q + r) % 500) for q in range(40) for r in range(1, 11)] + [(100, "small", r, 999 + r) for r in range(1, 4)] + [(101, "one", 1, 2000)]
    found = spark.createDataFrame(rows, "query_id bigint, subject string, rank int, card_id bigint")
    out = retrieval.replaced_at_random(found, cards, 1.0, 5).collect()
    before = {(q, r): c for q, _, r, c in rows}
    assert len(out) == len(rows) and {r.query_id: r.replaced for r in out if r.query_id == 101} == {101: False}
    for q in range(40):
        mine = [r for r in out if r.query_id == q]
        assert all(r.replaced for r in mine) and len({r.card_id for r in mine}) == 10 and not {r.card_id for r in mine} & {before[q, r] for r in range(1, 11)}
    small = sorted((r["rank"], r.card_id, r.replaced) for r in out if r.query_id == 100)
    assert small == [(1, 1003, True), (2, 1001, False), (3, 1002, False)]
    assert len({tuple(r.card_id for r in out if r.query_id == q) for q in range(40)}) == 40
    half = retrieval.replaced_at_random(found, cards, 0.5, 5).collect()
    assert {(r.query_id, r["rank"]): r.replaced for r in half if r.query_id < 40} == {(q, r): r <= 5 for q in range(40) for r in range(1, 11)}


def test_line_numbers_over_split_files(spark, tmp_path):
    """Files that are read in many pieces, of odd line lengths, with blank and refused lines."""
    for name, n in (("a", 3000), ("b", 7), ("c", 0)):
        (tmp_path / name).write_text("".join(("bad " if i % 13 == 0 else "" if i % 5 == 0 else "x" * (i % 97) + "\u2028") + f" {name}{i}" * (i % 5 > 0 or i % 13 == 0) + "\n" for i in range(1, n + 1)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = readers.read_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 20
        found = readers.line_numbers(lines, lines.where("value like 'bad %'")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.value.split()[1][0], r.line) for r in found) == [("a", i) for i in range(13, 3001, 13)]
    assert all(r.value == f"bad  {r.file[-1]}{r.line}" for r in found)


def test_corpus_reading(spark, tmp_path):
    good = json.dumps({"id": "1#2", "text": "a b", "title": "T", "section": "S"}, ensure_ascii=False)
    lines = [good, json.dumps({"id": "1#3", "text": 5}), json.dumps({"text": "x"}), "{", json.dumps({"id": "1#4", "text": "x" * (1 << 20)})]
    (tmp_path / "c.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    corpus, refused = readers.read_corpus(spark, str(tmp_path / "c.jsonl"))
    row = corpus.first()
    import hashlib

    assert (row.article_id, row.passage_id, row.title, row.section, row.text) == ("1", "1#2", "T", "S", "a b")
    assert row.line_sha256 == hashlib.sha256((good + "\n").encode()).hexdigest() and corpus.count() == 1
    assert sorted(r.problem for r in refused.collect()) == ["no JSON", "no id", "record too large", "text is no string"]


def test_json_lines_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ü "), (2, None)], "a int, b string")
    writers.write_jsonl(rows, str(tmp_path / "x"))
    assert sorted(readers.read_jsonl(spark, str(tmp_path / "x"), "a int, b string").collect()) == sorted(rows.collect())
    assert readers.all_prompts({"card_review": "judge"}) == {"card_review": "judge", "repair_review": "judge"}
