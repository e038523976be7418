"""The whole build: passage groups to a bank of grounded cards, all groups through one stage at a time.

Each stage asks a model about the groups that got so far, keeps what it said
in an append-only table of responses, checks the answers with columns, and
appends what passed to the table of stage results. Both tables are keyed by
hashes of what was asked, so a second run finds everything done and calls
nothing, and a run that lost executors repeats calls at most, never results.
Errors are values of a group; none stops the run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from decimal import Decimal

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.functions.records import CARD_FLAGS, PASSAGE, SELF_CHECK_FLAGS, STAGE_SPECS, STAGE_TYPES, STAGES
from gleaner.functions.responses import json_object, token_usage, usable
from gleaner.functions.strict import json_schema, plainly_fits, spark_type, violations
from gleaner.functions.text import bound, strip
from gleaner.operators import checks, export, intake, preparation, requests
from gleaner.operators.requests import RETRY, ModelOptions
from gleaner.plans.prompts import PROMPTS
from gleaner.sources.clustered import ClusteredCorpus
from gleaner.sources.readers import all_prompts, line_numbers, stored
from gleaner.sources.writers import append_by_task, append_table, bank_exports, fingerprint, observed, write_jsonl, write_table

VERSION = "gleaner-cards-1"
#: Waves of a round at most. A wave is two jobs, so their number must not grow with the calls; what stops a wave costs a 128th of a round.
MOST_WAVES = 128
NONE = "cast(array() as array<string>)"

#: Called with batches of (group_id, stage, call_sha256, attempt, body); gives (call_sha256, status_code, raw, latency_s).
Model = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
#: Seeds in, scored and selected candidates out (see preparation.py). One that brings further passages has their table as `corpus`.
Preparer = Callable[[DataFrame], DataFrame]

#: Adds errors array<string> to answers (group_id, stage, payload, passages, ...); an answer without any passes.
Validator = Callable[[DataFrame], DataFrame]

RESPONSE = "call_sha256 string, status_code int, raw string, latency_s double"
AUDIT = "group_id string, source_id string, passage_id string, is_seed boolean, issues array<string>, usage_cues int, boundary_cues int, usable boolean, length int, text_sha256 string, selected boolean, note string"
AUDIT_COLUMNS = [x.split()[0] for x in AUDIT.split(", ")]
#: One preparation of one group: the digest of what was asked, and the run that answered it.
PREPARED = ["group_id", "request_sha256", "batch"]
SEALED = "group_id string, request_sha256 string, batch string, rows long, fingerprint decimal(38,0)"
LOGGED = RESPONSE + ", group_id string, stage string, attempt int, called_at timestamp, run string"
RESULT = "stage string, group_id string, request_sha256 string, payload string, payload_sha256 string, call_sha256 string, attempt int"


@dataclass(frozen=True)
class Collected:
    """Answers that were collected elsewhere, by a batch service say, instead of a model.

    answers: (group_id, stage, attempt, status_code, raw, latency_s), one row
    for each call; a call without a row stays unanswered. Or what gives them
    for the prepared groups (group_id, group_order, ..., passages), once a run.
    """

    answers: DataFrame | Callable[[DataFrame], DataFrame]

    def to(self, asked: DataFrame) -> DataFrame:
        known = self.answers.select("group_id", "stage", "attempt", "status_code", "raw", "latency_s")
        return asked.select("call_sha256", "group_id", "stage", "attempt").join(known.hint("merge"), ["group_id", "stage", "attempt"]).select(*[x.split()[0] for x in RESPONSE.split(", ")])

    def of_round(self, asked: DataFrame, stage: str, attempt: int) -> DataFrame:
        """to() with what is logged of a call, where all are of one stage and attempt: only their answers are read, and joined by group alone."""
        known = self.answers.where((F.col("stage") == stage) & (F.col("attempt") == attempt)).select("group_id", "status_code", "raw", "latency_s")
        return asked.select("call_sha256", "group_id", "stage", "attempt").join(known.hint("merge"), "group_id")


@dataclass(frozen=True)
class Options:
    """prompts: a stage's system prompt where it differs from prompts.py. retry: what a model is told of a failed answer. schema_in_call: whether calls ask the service to keep to the stage's schema. calls_kept_together: a task asks so many calls (more where a round has more than MOST_WAVES waves of them) and then keeps their answers for good."""

    model: ModelOptions = field(default_factory=ModelOptions)
    limits: preparation.Limits = field(default_factory=preparation.Limits)
    repairs: int = 1
    prompts: dict = field(default_factory=dict, hash=False)
    prefix: str = "mem_"
    provider: str = "configured"
    retry: str = RETRY
    schema_in_call: bool = False
    calls_kept_together: int = 16

    def __post_init__(self):
        if self.repairs not in (0, 1) or self.calls_kept_together < 1:
            raise ValueError("repairs must be 0 or 1, calls_kept_together positive")

    def protocol(self) -> str:
        """What must not change between runs of one folder; concurrency may."""
        return repr((VERSION, replace(self.model, concurrency=1), self.limits, self.repairs, sorted(self.prompts.items()), self.prefix, self.provider, self.retry, self.schema_in_call))


def supplied(limits: preparation.Limits) -> Preparer:
    """Preparation from the given passages alone."""
    return lambda seeds: preparation.selection(preparation.supplied_candidates(preparation.scored(seeds)), limits)


@dataclass(frozen=True)
class same_article:
    """Preparation with further passages of the seeds' articles. A clustered corpus is neither shuffled nor scored again."""

    corpus: DataFrame | ClusteredCorpus
    prefix: str
    limits: preparation.Limits

    def __call__(self, seeds: DataFrame) -> DataFrame:
        corpus = self.corpus if isinstance(self.corpus, ClusteredCorpus) else preparation.scored(self.corpus)
        return preparation.selection(preparation.article_candidates(preparation.scored(seeds), corpus, self.prefix, self.limits.candidates), self.limits)

    def seed_errors(self, seeds: DataFrame) -> DataFrame:
        """(group_id, error) of groups with a seed that is not in the corpus as given; the first such seed's."""
        wrong = preparation.seed_errors(seeds, self.corpus, self.prefix).where("error is not null")
        return wrong.groupBy("group_id").agg(F.min_by(F.concat_ws(": ", "error", "passage_id"), "pos").alias("error"))


def candidate_errors(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """(group_id, error) of groups that lost a seed or hold a candidate more than once: missing_seeds() and repeated_candidates(), a group at a time.

    A group's ids are moved once. They are as many as a group's candidates, which selection() holds too.
    """
    ids = F.struct("source_id", "passage_id")
    given = seeds.groupBy("group_id").agg(F.collect_set(ids).alias("given"))
    offered = candidates.groupBy("group_id").agg(F.collect_list(ids).alias("offered"), F.collect_set(ids).alias("once"))
    none = F.expr("cast(array() as array<struct<source_id:string,passage_id:string>>)")
    both = given.join(offered.hint("merge"), "group_id", "full").select("group_id", *[F.coalesce(c, none).alias(c) for c in ("given", "offered", "once")])
    # an id that is null is equal to none
    lost = F.filter("given", lambda x: x["source_id"].isNull() | x["passage_id"].isNull() | ~F.array_contains("once", x))
    twice = F.when(F.size("offered") > F.size("once"), F.filter("once", lambda x: F.size(F.filter("offered", lambda y: y == x)) > 1)).otherwise(none)
    errors = F.concat(
        F.transform(lost, lambda x: F.concat(F.lit("seed is not among the candidates: "), x["passage_id"])), F.transform(twice, lambda x: F.concat(F.lit("repeated candidate: "), x["passage_id"]))
    )
    return both.select("group_id", errors.alias("errors")).where(F.size("errors") > 0).select("group_id", F.array_min("errors").alias("error"))


def sound(groups: DataFrame) -> DataFrame:
    """The groups, if there are any and nothing in them multiplies rows of later joins or contradicts itself.

    Passages that are too long or blank stop nothing: preparation filters them.
    """
    rows = intake.require_groups(groups).withColumn("group_row", F.monotonically_increasing_id())
    passages = rows.select("group_id", "group_row", F.posexplode("passages").alias("pos", "p")).select("group_id", "group_row", "pos", "p.*")
    wrong = intake.group_violations(passages).where(F.col("violation").isin("duplicate group_id", "duplicate passage in group", "conflicting texts")).head(5)
    if wrong:
        raise ValueError("passage groups break the rules: " + "; ".join(f"{r.violation} ({r.key})" for r in wrong))
    return groups


def citations_of(stage: str, v: Column) -> Column:
    """All citations in a stage's typed payload."""
    if stage == "extraction":
        return F.flatten(F.flatten(F.transform(v["cards"], lambda c: F.transform(c["grounding"], lambda g: g["evidence"]))))
    if stage in ("card_review", "repair_review"):
        return F.flatten(F.transform(v["cards"], lambda c: c["evidence"]))
    if stage == "card_repair":
        kept = F.filter(v["repairs"], lambda r: r["replacement"].isNotNull())
        return F.flatten(F.flatten(F.transform(kept, lambda r: F.transform(r["replacement"]["grounding"], lambda g: g["evidence"]))))
    return v["evidence"]


def grounding_errors(cards: Column) -> Column:
    """Of grounded cards: labels that are missing, extra or repeated."""

    def of(card: Column) -> Column:
        c = checks.coverage(card["card"], F.transform(card["grounding"], lambda g: checks.label(g["field"], g["item_index"])))
        wrong = F.size(c["missing"]) + F.size(c["extra"]) + F.size(c["repeated"]) > 0
        text = F.concat(F.lit("grounding: missing="), F.array_join(c["missing"], ","), F.lit("; extra="), F.array_join(c["extra"], ","), F.lit("; repeated="), F.array_join(c["repeated"], ","))
        return F.when(wrong, F.array(text)).otherwise(F.expr(NONE))

    return F.flatten(F.transform(cards, of))


def judged(card: Column) -> Column:
    return checks.gate([card[f] for f in CARD_FLAGS], card["issues"], card["missing_steps"])


def rejected_indexes(review: Column) -> Column:
    return F.array_sort(F.transform(F.filter(review["cards"], lambda c: ~judged(c)), lambda c: c["card_index"]))


def payload_errors(stage: str, value: Column, text: Column, passages: Column, candidates: Column, review: Column) -> Column:
    """array<string>: the schema's violations, or else those of citations and coverage.

    text: the payload's JSON; candidates: the number of cards under review; review: the typed card_review that a repair answers.
    """
    spec = STAGE_SPECS[stage]

    def of(v: Column) -> Column:
        shape = F.when(plainly_fits(value, text, v, spec), F.expr(NONE)).otherwise(violations(value, spec))
        return bound(shape, lambda wrong: F.when(F.size(wrong) > 0, wrong).otherwise(F.concat(*content_errors(stage, v, passages, candidates, review))))

    return bound(F.from_json(text, spark_type(spec)), of)


def content_errors(stage: str, v: Column, passages: Column, candidates: Column, review: Column) -> list[Column]:
    """What is wrong with the citations and the coverage of a typed payload, an array each."""
    parts = [checks.wrong_citations(citations_of(stage, v), passages)]
    if stage == "extraction":
        parts.append(grounding_errors(v["cards"]))
    elif stage in ("card_review", "repair_review"):
        fits = checks.covers(F.transform(v["cards"], lambda c: c["card_index"]), candidates)
        parts.append(F.when(~fits, F.array(F.lit("the review must judge every candidate once"))).otherwise(F.expr(NONE)))
    elif stage == "card_repair":
        fits = F.array_sort(F.transform(v["repairs"], lambda r: r["card_index"])) == rejected_indexes(review)
        parts.append(F.when(~fits, F.array(F.lit("the repair must name the rejected candidates, no others"))).otherwise(F.expr(NONE)))
        parts.append(grounding_errors(F.transform(F.filter(v["repairs"], lambda r: r["replacement"].isNotNull()), lambda r: r["replacement"])))
    return parts


def answering(model: Model, run: str) -> Model:
    """The model's answers with what they answer: rows for the table of responses. Answers to what was not asked are left out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[str, tuple] = {}  # of one task: as many calls as are kept together

        def noted() -> Iterator[pd.DataFrame]:
            for batch in batches:
                asked.update(zip(batch["call_sha256"], zip(batch["group_id"], batch["stage"], batch["attempt"])))
                yield batch

        for said in model(noted()):
            said = said[said["call_sha256"].isin(asked)]
            of = [asked[c] for c in said["call_sha256"]]
            yield said.assign(group_id=[x[0] for x in of], stage=[x[1] for x in of], attempt=[x[2] for x in of], called_at=pd.Timestamp.now(tz="UTC"), run=run)[[x.split()[0] for x in LOGGED.split(", ")]]

    return work


class Build:
    """A run in a folder. groups: (group_id, group_order, subject, corpus, language, passages array<struct>)."""

    def __init__(self, spark: SparkSession, folder: str, model: Model | Collected, options: Options = Options(), preparer: Preparer | None = None, validate: Validator | None = None):
        self.spark, self.folder, self.model, self.options, self.validate = spark, folder.rstrip("/"), model, options, validate
        self.preparer = preparer or supplied(options.limits)
        self.run_id, self.seals, self.tables, self.collected = uuid.uuid4().hex, [], [], model
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def laid_out(self, rows: DataFrame, name: str, *by: str) -> DataFrame:
        """Overwrite a table of the run, bucketed and sorted by group_id (in partitions, by what is named), and read it back: joins by group do not move its rows.

        As many buckets as a shuffle has partitions, since Spark would shuffle fewer again. The catalog's entry is the session's; the files are the run's.
        """
        n, table = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"gleaner_{uuid.uuid4().hex}"
        writer = rows.repartition(n, "group_id").write.format("parquet")
        (writer.partitionBy(*by) if by else writer).bucketBy(n, "group_id").sortBy("group_id").option("compression", "zstd").option("path", self.path(name)).mode("overwrite").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def check_identity(self, groups: DataFrame) -> None:
        """One manifest row per folder; other input, model, prompts or limits need another folder."""
        rows = groups.select(F.sha2(F.to_json(F.struct(*sorted(groups.columns))), 256).alias("h"))
        # order-insensitive and of fixed size, however many groups there are
        seal = rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("a"), F.sum(F.conv(F.substring("h", 16, 15), 16, 10).cast("decimal(38,0)")).alias("b")).first()
        now = (VERSION, self.options.protocol(), f"{seal.n}:{seal.a}:{seal.b}")
        schema = "version string, protocol string, input_digest string"
        try:
            # before anything else is written: of two runs of one folder, the second finds the first one's row
            self.spark.createDataFrame([now], schema).coalesce(1).write.mode("error").parquet(self.path("manifest"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            old = stored(self.spark, self.path("manifest"), schema).head(1)
            if not old or tuple(old[0]) != now:
                raise ValueError("input, model, prompts or limits changed, or another run is starting: use a new run folder") from None

    def put(self, rows: DataFrame, name: str, *by: str, as_json: bool = False) -> DataFrame | None:
        """Write an output and note its seal: how many rows, and the sum of their hashes, observed while they are written."""
        write = (lambda x: write_jsonl(x, self.path(name))) if as_json else (lambda x: write_table(x, self.path(name), *by))
        out, seen = observed(rows, write, *fingerprint(rows.columns))
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self.seals.append((name, as_json, ddl, seen.get("rows", 0), seen.get("fingerprint", Decimal(0))))
        return out

    def broken(self) -> list[str]:
        """Outputs of the finished run that are not as it sealed them."""
        out = []
        for r in self.spark.read.parquet(self.path("seals")).collect():  # a row an output
            rows = self.spark.read.schema(r.ddl)
            found = export.table_fingerprint((rows.json if r.as_json else rows.parquet)(self.path(r.output)).select(*[f"`{c}`" for c in self.columns(r.ddl)])).first()
            if (found.rows, found.fingerprint) != (r.rows, r.fingerprint):
                out.append(r.output)
        return sorted(out)

    def columns(self, ddl: str) -> list[str]:
        return StructType.fromDDL(ddl).fieldNames()

    def candidates(self, seeds: DataFrame) -> DataFrame:
        """The scored and selected candidates. Groups whose candidates an earlier run left, for the same seeds and whole, keep them; the others are prepared.

        A group's candidates are named by the digest of its seeds and limits,
        and sealed by their number and hashes once they are written. Rows
        without a seal that fits (an interrupted run, a damaged file) are
        nobody's; their groups are prepared again.
        """
        spark, audit, seals = self.spark, self.path("candidate_audit"), self.path("candidate_seals")
        schema = AUDIT + ", request_sha256 string, batch string"
        # at most five seeds a group
        given = F.to_json(F.array_sort(F.collect_list(F.struct("pos", "source_id", "passage_id", "title", "text"))))
        asked = write_table(seeds.groupBy("group_id").agg(F.sha2(F.concat_ws("\u001f", F.lit(repr((VERSION, self.options.limits))), given), 256).alias("request_sha256")), self.path("candidate_requests"))

        def whole() -> DataFrame:
            found = stored(spark, audit, schema).groupBy(*PREPARED).agg(*fingerprint(AUDIT_COLUMNS))
            fits = found.join(stored(spark, seals, SEALED).hint("merge"), [*PREPARED, "rows", "fingerprint"])
            return fits.join(asked.hint("merge"), ["group_id", "request_sha256"]).groupBy("group_id", "request_sha256").agg(F.min("batch").alias("batch"))

        missing = write_table(asked.join(whole().select("group_id").hint("merge"), "group_id", "left_anti"), self.path("candidates_missing"))
        if not missing.isEmpty():
            batch = F.lit(self.run_id)
            rows = self.preparer(seeds.join(missing.select("group_id").hint("merge"), "group_id", "left_semi")).select(*AUDIT_COLUMNS)
            append_table(rows.join(missing.hint("merge"), "group_id").withColumn("batch", batch).select(*AUDIT_COLUMNS, "request_sha256", "batch"), audit)
            mine = stored(spark, audit, schema).where(F.col("batch") == batch)
            append_table(mine.groupBy(*PREPARED).agg(*fingerprint(AUDIT_COLUMNS)), seals)
        kept = write_table(whole(), self.path("candidates_kept"))
        # joined by group alone, so that what reads the rows of a group does not move them again
        kept = kept.groupBy("group_id").agg(F.collect_set(F.struct("request_sha256", "batch")).alias("kept"))
        return stored(spark, audit, schema).join(kept.hint("merge"), "group_id").where(F.array_contains("kept", F.struct("request_sha256", "batch"))).select(*AUDIT_COLUMNS)

    def ask(self, asked: DataFrame, stage: str, attempt: int) -> None:
        """Ask the model, and keep its answers as they come.

        Calls are dealt to waves of `concurrency` tasks; a task asks
        `calls_kept_together` calls, or its share of a wave where MOST_WAVES
        would not do, and its answers are in the table of responses when it
        ends. What stops a run costs the calls of the tasks
        that were running, no others.
        """
        o, name = self.options, f"{stage}-{attempt}"
        n = asked.count()
        waves = min(-(-n // (o.model.concurrency * o.calls_kept_together)), MOST_WAVES)
        if not n:
            return
        dealt = write_table(asked.withColumn("wave", F.pmod(F.xxhash64("call_sha256"), F.lit(waves)).cast("int")).repartition("wave"), self.path(f"calls/{name}"), "wave")
        for wave in range(waves):
            calls = dealt.where(F.col("wave") == wave).drop("wave").repartition(o.model.concurrency)
            said = calls.mapInPandas(answering(self.model, self.run_id), LOGGED)
            _, seen = observed(said, lambda x: append_by_task(x, self.path("responses")), F.count("*").alias("answered"), F.count_if(F.col("status_code") == 200).alias("fine"))
            done = [(self.run_id, stage, attempt, wave + 1, waves, seen.get("answered", 0), seen.get("fine", 0))]
            append_table(self.spark.createDataFrame(done, "run string, stage string, attempt int, wave int, waves int, answered long, fine long").withColumn("at", F.current_timestamp()), self.path("call_progress"))

    def call(self, todo: DataFrame, stage: str, attempt: int) -> DataFrame:
        """One response for each of todo(group_id, stage, call_sha256, attempt, and body unless answers were collected) that has any: a stored one that is usable, or else the newest, after asking for what had none."""
        # the log's files are of one stage and attempt each; those of others are left out before anything is moved
        of_round = (F.col("stage") == stage) & (F.col("attempt") == attempt)
        log = lambda: usable(stored(self.spark, self.path("responses"), LOGGED).where(of_round).join(todo.select("call_sha256").hint("merge"), "call_sha256", "left_semi"))
        missing = todo.join(log().where("ok").select("call_sha256").hint("merge"), "call_sha256", "left_anti").dropDuplicates(["call_sha256"])
        if isinstance(self.model, Collected):
            fresh = self.collected.of_round(missing, stage, attempt).withColumns({"called_at": F.current_timestamp(), "run": F.lit(self.run_id)})
            append_table(fresh.select(*[x.split()[0] for x in LOGGED.split(", ")]), self.path("responses"))
        else:
            self.ask(missing.select("group_id", "stage", "call_sha256", "attempt", "body"), stage, attempt)
        best = F.max_by(F.struct("status_code", "raw", "latency_s"), F.struct("ok", "called_at"))
        return log().groupBy("call_sha256").agg(best.alias("r")).select("call_sha256", "r.*")

    def stage(self, stage: str, rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """(group_id, payload, error) for rows(group_id, subject, corpus, language, passages, record, candidates, review).

        texts: (group_id, passages) of all groups, laid_out(), from which answers are checked; without it they are taken from rows.
        """
        texts = rows.select("group_id", "passages") if texts is None else texts
        spark, o = self.spark, self.options
        group = F.struct("group_id", "subject", "corpus", "language", "passages")
        schema = json.dumps(json_schema(STAGE_SPECS[stage]))
        prompt = all_prompts({**PROMPTS, **o.prompts})[stage]
        user = requests.stage_message(group, F.col("record"), F.lit(schema))
        asked = rows.withColumn("stage", F.lit(stage)).withColumn("messages", F.array(requests.message("system", F.lit(prompt)), requests.message("user", user)))

        def body_of(messages: Column) -> Column:
            return requests.request_body(messages, o.model, requests.format_of(stage, schema, o.model.endpoint) if o.schema_in_call else None)

        def call_of(attempt: int, body: Column) -> Column:
            return F.sha2(F.concat_ws("\u001f", F.lit(stage), F.lit(attempt), body), 256)

        # the first call's hash is taken here, while the messages are at hand
        asked = asked.withColumns({"request_sha256": requests.request_hash(o.protocol(), stage, F.col("messages")), "first_call": call_of(1, body_of(F.col("messages")))}).drop("record", "passages")
        # the messages are stored here alone, and laid out by group as the passages are: rounds hold keys, answers and problems
        asked = self.laid_out(asked, f"requests/{stage}")
        keys = asked.select("group_id", "request_sha256")
        results = stored(spark, self.path("stage_results"), RESULT).where(F.col("stage") == stage)
        torn = keys.join(results.where(F.sha2("payload", 256) != F.col("payload_sha256")).select("request_sha256").distinct(), "request_sha256", "left_semi")
        torn = torn.select("group_id", F.lit(f"{stage}: stored payload does not match its checksum").alias("error"))
        nothing = F.lit(None).cast("string")
        todo = requests.pending(keys, results).join(torn.select("group_id"), "group_id", "left_anti").withColumns({"last_error": nothing, "answer": nothing})
        for attempt in range(1, o.model.retries + 2):
            body = body_of(F.col("messages") if attempt == 1 else requests.with_retry(F.slice("messages", 1, 2), F.col("answer"), F.col("last_error"), o.retry))
            if attempt > 1:
                # few rows as a rule, and none often: then no message is read
                todo = write_table(todo, self.path(f"again/{stage}-{attempt}"))
                if todo.isEmpty():
                    break
            named = asked.select("group_id", "messages", "first_call").join(todo.hint("merge"), "group_id").withColumns({"attempt": F.lit(attempt), "stage": F.lit(stage)})
            named = named.withColumn("call_sha256", F.col("first_call") if attempt == 1 else call_of(attempt, body))
            todo = write_table(named.select("group_id", "request_sha256", "last_error", "answer", "stage", "attempt", "call_sha256"), self.path(f"rounds/{stage}-{attempt}"))
            if todo.isEmpty():
                break
            if isinstance(self.model, Collected):
                calls = todo
            else:
                calls = asked.select("group_id", "messages").join(todo.hint("merge"), "group_id").withColumn("body", body).drop("messages")
            said = usable(self.call(calls, stage, attempt)).select("call_sha256", "content", "ok", "error")
            got = todo.drop("stage").join(said.hint("merge"), "call_sha256", "left").withColumn("parsed", json_object(F.coalesce("content", F.lit(""))))
            got = asked.drop("request_sha256", "first_call").join(got.hint("merge"), "group_id").join(texts.hint("merge"), "group_id")
            value = F.col("parsed.value")
            got = got.withColumn("payload", F.to_json(value))
            wrong = payload_errors(stage, value, F.col("payload"), F.col("passages"), F.col("candidates"), F.from_json("review", STAGE_TYPES["card_review"]))
            problem = F.when(~F.coalesce("ok", F.lit(False)), F.coalesce("error", F.lit("no response"))).when(value.isNull(), F.col("parsed.error")).otherwise(F.get(wrong, F.lit(0)))
            got = got.withColumn("problem", problem).drop("parsed")
            if self.validate is not None:
                got = self.validate(got).withColumn("problem", F.coalesce("problem", F.get("errors", F.lit(0)))).drop("errors")
            got = write_table(got.select("stage", "group_id", "request_sha256", "call_sha256", "attempt", "content", "ok", "problem", "payload"), self.path(f"checked/{stage}-{attempt}"))
            good = got.where("problem is null").select("stage", "group_id", "request_sha256", "payload", F.sha2("payload", 256).alias("payload_sha256"), "call_sha256", "attempt")
            append_table(good, self.path("stage_results"))
            answer = F.when(F.coalesce("ok", F.lit(False)), F.col("content"))
            todo = got.where("problem is not null").select("group_id", "request_sha256", F.col("problem").alias("last_error"), answer.alias("answer"))
        failed = todo.select("group_id", F.concat(F.lit(f"{stage}: "), "last_error").alias("error"))
        results = stored(spark, self.path("stage_results"), RESULT).where(F.col("stage") == stage)
        done = requests.reusable(keys, results).select("group_id", "payload", F.lit(None).cast("string").alias("error"))
        bad = failed.unionByName(torn).join(done.select("group_id"), "group_id", "left_anti").select("group_id", F.lit(None).cast("string").alias("payload"), "error")
        found = write_table(done.unionByName(bad), self.path(f"stages/{stage}"))
        counts = found.agg(F.lit(stage).alias("stage"), F.count("*").alias("groups"), F.count("payload").alias("passed"), F.count("error").alias("failed"), F.current_timestamp().alias("at"))
        append_table(counts, self.path("stage_progress"))
        return found

    def run(self, groups: DataFrame) -> DataFrame:
        """Run all stages and write every output; gives the outcomes (group_id, status, rejection_stage, error)."""
        self.run_id, self.seals = uuid.uuid4().hex, []
        self.check_identity(sound(groups))
        groups = self.laid_out(groups, "passage_groups")
        empty = self.spark.createDataFrame([(False,)], "complete boolean")
        write_table(empty, self.path("summary"))
        seeds = groups.select("group_id", F.posexplode("passages").alias("pos", "p")).select("group_id", "pos", "p.*")
        if isinstance(self.preparer, same_article):
            astray = write_table(self.preparer.seed_errors(seeds), self.path("seed_errors"))
            seeds = seeds.join(astray, "group_id", "left_anti")
            audit = self.candidates(seeds)
            faults = astray.unionByName(candidate_errors(seeds, audit))
        else:
            audit = self.candidates(seeds)
            faults = candidate_errors(seeds, audit)
        faults = write_table(faults.withColumn("error", F.concat(F.lit("source_preparation: "), "error")), self.path("preparation_errors"))
        ready = preparation.prepared_groups(audit, seeds, getattr(self.preparer, "corpus", None)).join(groups.drop("passages").hint("merge"), "group_id").join(faults.hint("merge"), "group_id", "left_anti")
        blank = {"candidates": F.lit(0), "review": F.lit(None).cast("string")}
        state = self.laid_out(ready.withColumns(blank), "prepared_passage_groups")
        texts = state.select("group_id", "passages")
        if isinstance(self.model, Collected) and callable(self.model.answers):
            self.collected = Collected(self.laid_out(self.model.answers(state), "collected_answers", "stage"))

        payloads: dict[str, DataFrame] = {}

        def ask(stage: str, rows: DataFrame, *context: str) -> DataFrame:
            """Run a stage on rows, which hold the payloads named in context; gives rows with the stage's payload."""
            parts = [F.concat(F.lit(f'"{c.removeprefix("revised_")}":'), F.col(c)) for c in context]
            record = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")
            payloads[stage] = self.stage(stage, rows.withColumn("record", record).select("group_id", "subject", "corpus", "language", "passages", "record", "candidates", "review"), texts)
            return rows.join(payloads[stage].where("payload is not null").select("group_id", F.col("payload").alias(stage)).hint("merge"), "group_id")

        def kept_as(name: str, rows: DataFrame) -> DataFrame:
            """Rows written without their passages, which are joined again where they are asked for."""
            return write_table(rows.drop("passages"), self.path(name)).join(texts.hint("merge"), "group_id")

        def typed(stage: str, column: str | None = None) -> Column:
            return F.from_json(column or stage, STAGE_TYPES[stage])

        rows = ask("application", state)
        rows = ask("solution", rows, "application")
        rows = ask("self_check", rows, "application", "solution")
        check = typed("self_check")
        rows = rows.where(checks.gate([check[f] for f in SELF_CHECK_FLAGS], check["issues"]))
        rows = ask("extraction", rows, "application", "solution", "self_check")
        rows = rows.withColumn("candidates", F.size(typed("extraction")["cards"])).where("candidates > 0")
        rows = kept_as("reviewed", ask("card_review", rows, "application", "solution", "extraction"))
        bad = F.size(rejected_indexes(typed("card_review"))) > 0
        fine = rows.where(~bad) if self.options.repairs else rows
        to_fix = (rows.where(bad) if self.options.repairs else rows.limit(0)).withColumn("review", F.col("card_review"))
        fixed = ask("card_repair", to_fix, "application", "solution", "extraction", "card_review")
        repairs = typed("card_repair")["repairs"]
        indexed = F.transform(typed("extraction")["cards"], lambda c, i: F.struct(i.alias("i"), c.alias("c"), F.filter(repairs, lambda r: r["card_index"] == i).alias("r")))
        kept = F.filter(F.transform(indexed, lambda x: F.struct(x["i"].alias("i"), F.when(F.size(x["r"]) > 0, x["r"][0]["replacement"]).otherwise(x["c"]).alias("c"))), lambda x: x["c"].isNotNull())
        fixed = fixed.withColumn("kept", kept).withColumn("revised_extraction", F.to_json(F.struct(F.transform("kept", lambda x: x["c"]).alias("cards")), {"ignoreNullFields": "false"}))
        fixed = fixed.withColumns({"candidates": F.size("kept"), "kept_from": F.transform("kept", lambda x: x["i"])}).drop("kept")
        fixed = kept_as("repaired", fixed)
        again = kept_as("rereviewed", ask("repair_review", fixed.where("candidates > 0"), "application", "solution", "revised_extraction"))

        common = ["group_id", "group_order", "subject"]
        final = fine.select(*common, F.col("extraction").alias("e"), F.col("card_review").alias("r"), F.lit(None).cast("array<int>").alias("kept_from"), F.lit("extraction").alias("extraction_stage"), F.lit("card_review").alias("review_stage")).unionByName(
            again.select(*common, F.col("revised_extraction").alias("e"), F.col("repair_review").alias("r"), "kept_from", F.lit("repaired_extraction").alias("extraction_stage"), F.lit("repair_review").alias("review_stage"))
        )
        final = final.withColumns({"cards": F.from_json("e", STAGE_TYPES["extraction"])["cards"], "verdicts": F.from_json("r", STAGE_TYPES["card_review"])["cards"]})
        passed = final.select(*common, "extraction_stage", "review_stage", "kept_from", "verdicts", F.posexplode("cards").alias("card_index", "grounded"))
        passed = passed.withColumn("verdict", F.get(F.filter("verdicts", lambda v: v["card_index"] == F.col("card_index")), F.lit(0))).where(judged(F.col("verdict")))
        origin = F.struct(
            "group_id", F.col("card_index").alias("candidate_index"), F.coalesce(F.get("kept_from", F.col("card_index")), F.col("card_index")).alias("original_candidate_index"), "extraction_stage", "review_stage",
            F.col("verdict").alias("review"), F.col("grounded.grounding").alias("grounding"),
        )
        c = F.col("grounded.card")
        clean = F.struct(strip(c["concept_name"]).alias("concept_name"), strip(c["definition"]).alias("definition"), *[F.transform(c[x], strip).alias(x) for x in ("trigger", "decision", "pitfall")])
        accepted = write_table(export.keyed(passed.select("group_order", "card_index", "group_id", "subject", clean.alias("card"), origin.alias("origin"))), self.path("accepted_cards"))
        outcomes = self.outcomes(groups, faults, state, payloads, accepted)
        self.write_outputs(outcomes, audit, payloads, accepted)
        for table in self.tables:
            self.spark.sql(f"drop table {table}")  # the catalog's entry, not the files
        self.tables = []
        return outcomes

    def outcomes(self, groups: DataFrame, faults: DataFrame, state: DataFrame, payloads: dict[str, DataFrame], accepted: DataFrame) -> DataFrame:
        out = groups.select("group_id", "group_order", "subject").join(state.select("group_id", F.lit(True).alias("prepared")), "group_id", "left")
        out = out.join(faults.withColumnRenamed("error", "preparation_error"), "group_id", "left")
        for stage, found in payloads.items():
            out = out.join(found.select("group_id", F.col("payload").alias(stage), F.col("error").alias(f"{stage}_error")), "group_id", "left")
        out = out.join(accepted.select("group_id").distinct().withColumn("accepted", F.lit(True)), "group_id", "left")
        check = F.from_json("self_check", STAGE_TYPES["self_check"])
        repairs = F.from_json("card_repair", STAGE_TYPES["card_repair"])["repairs"]
        n = F.size(F.from_json("extraction", STAGE_TYPES["extraction"])["cards"])
        dropped = F.size(F.filter(repairs, lambda r: r["replacement"].isNull()))
        errors = ["preparation_error", *[f"{s}_error" for s in payloads]]
        o = export.outcome(
            F.col("prepared"), checks.gate([check[f] for f in SELF_CHECK_FLAGS], check["issues"]), n, n - dropped, F.col("accepted"), F.col("card_repair").isNotNull(), F.coalesce(*errors)
        )
        out = out.withColumns({"o": o, "error": F.coalesce(*errors)})
        return write_table(out.select("group_id", "group_order", "subject", "o.status", "o.rejection_stage", "error", *payloads), self.path("outcomes"), "status")

    def write_outputs(self, outcomes: DataFrame, audit: DataFrame, payloads: dict[str, DataFrame], accepted: DataFrame) -> None:
        records = ["group_id", "group_order", "subject", "status", "rejection_stage", "error", *payloads]
        for status, name in ((None, "synthesis_records"), ("rejected", "rejected_records"), ("error", "errors")):
            self.put((outcomes if status is None else outcomes.where(F.col("status") == status)).select(*records), name, as_json=True)
        verdicts = [
            payloads[s].where("payload is not null").select("group_id", F.lit(s).alias("stage"), F.explode(F.from_json("payload", STAGE_TYPES["card_review"])["cards"]).alias("judgment")) for s in ("card_review", "repair_review")
        ]
        rejections = self.put(verdicts[0].unionByName(verdicts[1]).where(~judged(F.col("judgment"))), "card_rejections")
        bank = self.put(export.dense_index(export.bank(accepted, self.options.prefix), ["group_order", "card_index"]), "bank_table")
        origins = self.put(export.lineage(accepted, self.options.prefix), "bank_origins")
        for name, rows in bank_exports(bank, origins).items():
            self.put(rows, f"export/{name}", as_json=True)
        prep = preparation.preparation_summary(audit).agg(F.coalesce(F.sum("filtered_seeds"), F.lit(0)).alias("filtered_seed_passages"), F.coalesce(F.sum("supplementary_passages"), F.lit(0)).alias("supplementary_passages"))
        one = F.lit(1).alias("one")
        totals = export.progress(outcomes).select("*", one)
        for part in (
            bank.agg(F.count("*").alias("cards")), outcomes.agg(F.count_if(F.col("card_repair").isNotNull()).alias("groups_with_repair")), rejections.agg(F.count("*").alias("rejected_card_reviews")), prep,
            token_usage(stored(self.spark, self.path("responses"), LOGGED).withColumn("cached", F.col("run") != self.run_id)),
        ):
            totals = totals.join(part.select("*", one), "one")
        sealed = {name: seal for name, _, _, _, seal in self.seals}
        totals = totals.withColumns({"bank_fingerprint": F.lit(sealed["bank_table"]), "complete": F.col("errors") == 0})
        write_table(self.spark.createDataFrame(self.seals, "output string, as_json boolean, ddl string, rows long, fingerprint decimal(38,0)"), self.path("seals"))
        write_table(totals.drop("one"), self.path("summary"))
        write_table(export.progress(outcomes), self.path("progress"))

    def bank(self) -> DataFrame:
        return self.spark.read.parquet(self.path("bank_table"))

    def origins(self) -> DataFrame:
        """(content_key, memory_id, origin_no, group_order, card_index, origin): which accepted cards each card of the bank stands for."""
        return self.spark.read.parquet(self.path("bank_origins"))

    def summary(self) -> DataFrame:
        return self.spark.read.parquet(self.path("summary"))


def validated(lines: DataFrame, corpora: tuple[str, ...], languages: tuple[str, ...] = ("en",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Input checked without a model or a folder: valid groups, refused lines with their problem, and what groups break together.

    lines: (value, ...) of JSON; of read_lines()'s rows the refused ones have their line number too. Without a valid group it stops.
    """
    parsed = intake.parsed_groups(lines, corpora, languages)
    groups = intake.require_groups(intake.valid_groups(parsed))
    rows = groups.withColumn("group_row", F.monotonically_increasing_id())
    passages = rows.select("group_id", "group_row", F.posexplode("passages").alias("pos", "p")).select("group_id", "group_row", "pos", "p.*")
    refused = intake.quarantine(parsed)
    if {"file", "block", "place"} <= set(lines.columns):
        refused = line_numbers(lines, refused)
    return groups, refused, intake.group_violations(passages)


def group_schema() -> str:
    return f"group_id string, group_order bigint, subject string, corpus string, language string, passages array<{PASSAGE}>"

