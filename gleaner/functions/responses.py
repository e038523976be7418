"""What a model service returned: content, completeness, errors, token usage and the JSON object in the content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import bound


def _text(raw: Column, path: str) -> Column:
    """The string at a path; null unless it is a string."""
    value = F.try_variant_get(raw, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def content(raw: Column) -> Column:
    """The text of a response, from the first place that has it: chat message, completion text, output_text, output parts."""
    messages = F.filter(F.try_variant_get(raw, "$.output", "array<variant>"), lambda m: _text(m, "$.type") == "message")
    parts = F.flatten(F.transform(messages, lambda m: F.coalesce(F.try_variant_get(m, "$.content", "array<variant>"), F.expr("cast(array() as array<variant>)"))))
    texts = F.transform(F.filter(parts, lambda p: _text(p, "$.type") == "output_text"), lambda p: _text(p, "$.text"))
    return F.coalesce(_text(raw, "$.choices[0].message.content"), _text(raw, "$.choices[0].text"), _text(raw, "$.output_text"), F.array_join(texts, ""), F.lit(""))


def completed(raw: Column) -> Column:
    """Neither stopped early nor failed, by status and by the first choice's finish reason."""
    status = F.coalesce(_text(raw, "$.status"), F.lit(""))
    reason = F.try_variant_get(raw, "$.choices[0].finish_reason", "variant")
    fine = F.coalesce(F.is_variant_null(reason), F.lit(True)) | reason.isNull() | (_text(raw, "$.choices[0].finish_reason") == "stop")
    is_object = F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))
    return is_object & ~status.isin("incomplete", "failed", "cancelled") & F.coalesce(fine, F.lit(False))


def error_text(raw: Column) -> Column:
    """The service's own words for what went wrong, as far as there are any."""
    inner = F.try_variant_get(raw, "$.error", "variant")
    is_object = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))

    def said(path: str) -> Column:
        return F.nullif(F.try_variant_get(raw, path, "string"), F.lit(""))

    return F.coalesce(F.when(is_object, F.coalesce(said("$.error.message"), said("$.error.type"), F.lit("api_error"))), F.when(~is_object, said("$.error")), said("$.message"), F.lit("empty_content"))


def json_object(text: Column) -> Column:
    """struct(value variant, error string): the JSON object in a model's answer.

    A leading think block is dropped (an unclosed one is an error), then a
    code fence; if the rest is no JSON, what stands from the first opening to
    the last closing brace is tried.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    return bound(F.when(text.rlike(r"^[ \t\r\n]*\{"), F.try_parse_json(text)), lambda whole: F.when(whole.isNotNull(), _found(whole, F.lit(None).cast("string"))).otherwise(bound(bare, _wrapped)))


def _found(value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def _wrapped(bare: Column) -> Column:
    """json_object() of a text that is no JSON object as a whole."""
    thinking = bare.startswith("<think>")
    closed = F.locate("</think>", bare) > 0
    after = F.when(thinking, F.regexp_replace(bare, r"(?s)^.*?</think>\s*", "")).otherwise(bare)

    def inner(fenced: Column) -> Column:
        start = F.locate("{", fenced)
        end = F.length(fenced) - F.locate("}", F.reverse(fenced)) + 1
        return F.when((start > 0) & (F.locate("}", fenced) > 0) & (end > start), F.substring(fenced, start, end - start + 1))

    def read(value: Column) -> Column:
        root = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
        return _found(value, F.when(thinking & ~closed, F.lit("unfinished thinking block")).when(value.isNull(), F.lit("no JSON")).when(~root, F.lit("root is no object")))

    fenced = F.regexp_replace(F.regexp_replace(after, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return bound(fenced, lambda x: bound(F.coalesce(F.try_parse_json(x), F.try_parse_json(inner(x))), read))


def usable(responses: DataFrame) -> DataFrame:
    """responses(status_code, raw string, ...) with content, ok and error. ok: 2xx, complete, and with content."""
    # column by column, so that a response is parsed once
    raw, done = F.col("_raw"), F.col("_done")
    rows = responses.withColumn("_raw", F.try_parse_json("raw")).withColumns({"content": content(raw), "_done": completed(raw)})
    rows = rows.withColumn("ok", F.coalesce(F.col("status_code").between(200, 299), F.lit(False)) & (F.length("content") > 0) & done)
    return rows.withColumn("error", F.when(~F.col("ok"), F.when(done, error_text(raw)).otherwise(F.lit("incomplete_model_output")))).drop("_raw", "_done")


def token_usage(responses: DataFrame) -> DataFrame:
    """Totals over responses(raw, cached): prompt, completion and all tokens of calls that were not cached. Zero counts as absent."""
    raw = F.try_parse_json("raw")

    def number(*names: str) -> Column:
        found = [F.nullif(F.try_variant_get(raw, f"$.usage.{n}", "bigint"), F.lit(0)) for n in names]
        return F.coalesce(*found, F.lit(0))

    prompt, done = number("prompt_tokens", "input_tokens"), number("completion_tokens", "output_tokens")
    rows = responses.where(~F.coalesce("cached", F.lit(False))).select(prompt.alias("p"), done.alias("c"), number("total_tokens").alias("t"))
    total = F.when(F.col("t") > 0, F.col("t")).otherwise(F.col("p") + F.col("c"))
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(n) for x, n in ((F.col("p"), "prompt_tokens"), (F.col("c"), "completion_tokens"), (total, "total_tokens"))]
    return rows.agg(F.count("*").alias("calls"), *sums)
