"""Closed schemas for JSON: unknown keys, missing keys and coerced types are errors.

Checks read the parsed value as a variant, element by element, because Spark's
schema of a whole array merges its elements' types and hides what differs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import bound, strip


@dataclass(frozen=True)
class Text:
    """A string that is not blank, of at most `most` characters once stripped; optional and blank where `blank`."""

    most: int | None = None
    blank: bool = False
    required: bool = True


@dataclass(frozen=True)
class Flag:
    required: bool = True


@dataclass(frozen=True)
class Index:
    """A whole number of 0 or more; JSON null too where `null`."""

    null: bool = False
    required: bool = True


@dataclass(frozen=True)
class Choice:
    values: tuple[str, ...]
    required: bool = True


@dataclass(frozen=True)
class Items:
    item: object
    least: int = 0
    most: int | None = None
    required: bool = True


@dataclass(frozen=True)
class Record:
    fields: dict = field(default_factory=dict, hash=False)
    null: bool = False
    required: bool = True


NONE = "cast(array() as array<string>)"


def _say(bad: Column, *label: Column | str) -> Column:
    text = F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in label])
    return F.when(F.coalesce(bad, F.lit(True)), F.array(text)).otherwise(F.expr(NONE))


def violations(value: Column, spec, path: Column | str = "$") -> Column:
    """array<string> of what is wrong with a variant; empty if it fits the spec."""
    at = path if isinstance(path, Column) else F.lit(path)
    kind = F.schema_of_variant(value)
    if isinstance(spec, Text):
        text = F.try_variant_get(value, "$", "string")
        long = strip(text) if spec.most else text
        wrong = [_say(kind != "STRING", at, ": string expected")]
        if not spec.blank:
            wrong.append(_say((kind == "STRING") & (F.length(strip(text)) == 0), at, ": blank"))
        if spec.most:
            wrong.append(_say((kind == "STRING") & (F.length(long) > spec.most), at, ": too long"))
        return F.concat(*wrong)
    if isinstance(spec, Flag):
        return _say(kind != "BOOLEAN", at, ": boolean expected")
    if isinstance(spec, Index):
        fits = (kind == "BIGINT") & (F.try_variant_get(value, "$", "bigint") >= 0)
        return _say(~(fits | (kind == "VOID")) if spec.null else ~fits, at, ": index expected")
    if isinstance(spec, Choice):
        return _say(~((kind == "STRING") & F.try_variant_get(value, "$", "string").isin(*spec.values)), at, ": not among the choices")
    if isinstance(spec, Items):

        def of_items(items: Column) -> Column:
            n = F.size(items)
            bad_size = (n < spec.least) if spec.most is None else (n < spec.least) | (n > spec.most)
            each = F.flatten(F.transform(items, lambda e, i: violations(e, spec.item, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
            return F.when(items.isNull() | ~kind.startswith("ARRAY"), F.array(F.concat(at, F.lit(": list expected")))).otherwise(F.concat(_say(bad_size, at, ": wrong number of items"), each))

        return bound(F.try_variant_get(value, "$", "array<variant>"), of_items)
    if isinstance(spec, Record):
        known = F.array(*[F.lit(k) for k in spec.fields])
        needed = [k for k, s in spec.fields.items() if s.required]

        def of_names(names: Column) -> Column:
            parts = [F.transform(F.array_sort(F.array_except(names, known)), lambda k: F.concat(at, F.lit("."), k, F.lit(": unknown key")))]
            if needed:
                parts.append(F.transform(F.array_sort(F.array_except(F.array(*[F.lit(k) for k in needed]), names)), lambda k: F.concat(at, F.lit("."), k, F.lit(": missing"))))
            for name, inner in spec.fields.items():
                inside = bound(F.try_variant_get(value, f"$.{name}", "variant"), lambda v: violations(v, inner, F.concat(at, F.lit("." + name))))  # noqa: B023
                parts.append(F.when(F.array_contains(names, name), inside).otherwise(F.expr(NONE)))
            return F.when(names.isNull() | ~kind.startswith("OBJECT"), F.array(F.concat(at, F.lit(": object expected")))).otherwise(F.concat(*parts))

        checked = bound(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), of_names)
        return F.when(kind == "VOID", F.expr(NONE)).otherwise(checked) if spec.null else checked
    raise TypeError(f"no such spec: {spec!r}")


def spark_type(spec) -> str:
    """The type that a spec's values are read into: an object's fields in the order of their names, as a variant has them."""
    if isinstance(spec, Items):
        return f"array<{spark_type(spec.item)}>"
    if isinstance(spec, Record):
        return f"struct<{','.join(f'`{k}`:{spark_type(spec.fields[k])}' for k in sorted(spec.fields))}>"
    return {Flag: "boolean", Index: "int"}.get(type(spec), "string")


def _within(v: Column, spec) -> Column:
    """Whether a typed value keeps to what its type does not say: no nulls, no blanks, bounds and choices."""
    if isinstance(spec, Text):
        fine = v.isNotNull() if spec.blank else F.length(strip(v)) > 0
        fine = fine & (F.length(strip(v)) <= spec.most) if spec.most else fine
    elif isinstance(spec, Flag):
        fine = v.isNotNull()
    elif isinstance(spec, Index):
        return F.coalesce(v >= 0, F.lit(spec.null))
    elif isinstance(spec, Choice):
        fine = v.isin(*spec.values)
    elif isinstance(spec, Items):
        fine = (F.size(v) >= spec.least) & F.forall(v, lambda e: _within(e, spec.item))
        fine = fine & (F.size(v) <= spec.most) if spec.most is not None else fine
    else:
        fine = v.isNotNull()
        for name, inner in spec.fields.items():
            fine = fine & _within(v[name], inner)
        return F.coalesce(fine, F.lit(False)) | v.isNull() if spec.null else F.coalesce(fine, F.lit(False))
    return F.coalesce(fine, F.lit(False))


def plainly_fits(value: Column, text: Column, typed: Column, spec) -> Column:
    """True only if violations(value, spec) is empty, and then nearly always; many times cheaper.

    text: the variant's JSON; typed: that read as spark_type(spec). What is
    written back from the typed value is the same text only if no key is
    missing or unknown and no value was coerced, except for 1.0 as an index.
    """
    kinds = F.schema_of_variant(value)
    same = F.to_json(typed, {"ignoreNullFields": "false"}) == text
    return F.coalesce(same & ~F.contains(kinds, F.lit("DECIMAL")) & ~F.contains(kinds, F.lit("DOUBLE")) & _within(typed, spec), F.lit(False))


def first_problem(text: Column, spec) -> Column:
    """null if the JSON text fits the spec, else the first thing that is wrong."""
    value = F.try_parse_json(text)
    return F.when(value.isNull(), F.lit("$: no JSON")).otherwise(F.get(violations(value, spec), F.lit(0)))


def json_schema(spec) -> dict:
    """A spec as JSON Schema, to be shown to a model."""
    if isinstance(spec, Text):
        return {"type": "string", **({} if spec.blank else {"minLength": 1}), **({"maxLength": spec.most} if spec.most else {})}
    if isinstance(spec, Flag):
        return {"type": "boolean"}
    if isinstance(spec, Index):
        return {"type": ["integer", "null"] if spec.null else "integer", "minimum": 0}
    if isinstance(spec, Choice):
        return {"type": "string", "enum": list(spec.values)}
    if isinstance(spec, Items):
        return {"type": "array", "items": json_schema(spec.item), "minItems": spec.least, **({} if spec.most is None else {"maxItems": spec.most})}
    fields = {k: json_schema(v) for k, v in spec.fields.items()}
    required = [k for k, v in spec.fields.items() if v.required]
    return {"type": ["object", "null"] if spec.null else "object", "properties": fields, "required": required, "additionalProperties": False}
