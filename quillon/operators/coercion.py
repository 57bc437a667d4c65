"""Replies of a model, which are untrusted JSON, in fixed shapes.

A shape is a table of fields; ``coerced`` compiles it to VARIANT expressions, so a
reply is read inside the engine, a row at a time, whatever its depth.

Defined results: a reply that is null, empty or has no JSON object gives ``ok`` false,
every field's default and no errors.  A field that is absent, null or of another kind
has its default.  An item of a list that isn't a record (or a plain text, where those
are allowed), or whose required field is blank, isn't kept.  ``errors`` names the place of
each of these items, of each value outside a fixed set and of each list of ids with something
else in it, in the order of the fields.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.grounding import CATEGORIES, DECISIONS, KINDS

#: How far a study is needed where the reply doesn't say.
NECESSITY = "возможно требуется"


class Field(NamedTuple):
    """How a value is read from a VARIANT, and what is wrong with it (null: nothing)."""

    read: Callable[[Column], Column]
    check: Callable[[Column], Column] = lambda v: F.lit(None).cast("string")


class Items(NamedTuple):
    """A list of records with ``required`` filled; a plain text may stand for a record with that field alone."""

    fields: dict[str, Field]
    required: str
    plain: bool = False


class Record(NamedTuple):
    fields: dict[str, Field]


Shape = dict[str, Field | Items | Record]


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _as_text(v: Column) -> Column:
    """Texts as they are, anything else as JSON; null for null."""
    return _get(v, "$", "string")


def _list(v: Column) -> Column:
    return F.coalesce(_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _filled(v: Column) -> Column:
    """False for null, false, zero, and what is empty."""
    return ~F.coalesce(_as_text(v), F.lit("")).rlike(r"^(false|-?0(\.0*)?([eE][-+]?[0-9]+)?|\[\]|\{\}|)$") | ((F.schema_of_variant(v) == "STRING") & (_as_text(v) != ""))


def words(default: str = "") -> Field:
    return Field(lambda v: T.trimmed(F.coalesce(_as_text(v), F.lit(default))))


def required() -> Field:
    return Field(lambda v: F.when(_filled(v), T.trimmed(_as_text(v))).otherwise(""), lambda v: F.when(~F.coalesce(_filled(v), F.lit(False)) | (T.trimmed(_as_text(v)) == ""), "empty"))


def one_of(values: list[str], default: str, lower: bool = True) -> Field:
    said = lambda v: F.lower(_as_text(v)) if lower else _as_text(v)
    return Field(lambda v: F.when(said(v).isin(values), said(v)).otherwise(default), lambda v: F.when(~said(v).isin(values), F.concat(F.lit("unknown value "), _as_text(v))))


def flag() -> Field:
    return Field(lambda v: F.coalesce(_filled(v), F.lit(False)))


def texts() -> Field:
    return Field(lambda v: F.transform(F.filter(_list(v), _filled), _as_text))


def ids() -> Field:
    whole = lambda v: F.filter(F.transform(_list(v), lambda i: F.when(_as_text(i).rlike("^[0-9]+$"), _as_text(i).try_cast("int"))), lambda i: i.isNotNull())
    return Field(whole, lambda v: F.when(F.size(whole(v)) < F.size(_list(v)), "not all are ids"))


def statements(kind: str) -> Items:
    return Items({"kind": one_of(KINDS, kind, lower=False), "text": required(), "citation_ids": ids()}, "text", plain=True)


def decision() -> Record:
    return Record({"status": one_of(DECISIONS, "insufficient_data"), "rationale": words(), "conditions": texts(), "citation_ids": ids()})


CHAT: Shape = {
    "answer_markdown": words(), "statements": statements("regulatory_interpretation"), "sufficient_basis": flag(), "clarifying_questions": texts(), "limitations": texts(),
}
ASSESSMENT: Shape = {
    "input_sufficient": flag(),
    "clarifying_questions": texts(),
    "product_classification": words(),
    "registration_strategy": statements("regulatory_interpretation"),
    "required_studies": Items(
        {"category": one_of(CATEGORIES, "clinical"), "name": required(), "necessity": words(NECESSITY), "rationale": words(), "kind": one_of(KINDS, "regulatory_interpretation", lower=False), "citation_ids": ids()}, "name"
    ),
    "bioequivalence": decision(),
    "biowaiver": decision(),
    "additional_strengths": decision(),
    "regulatory_risks": statements("regulatory_risk"),
    "potential_authority_questions": statements("potential_authority_question"),
    "conflicts": Items({"description": required(), "citation_ids": ids(), "resolution_note": words()}, "description"),
    "limitations": texts(),
}


def _read(v: Column, fields: dict[str, Field], plain: str | None = None) -> tuple[Column, Column]:
    """A record's values, and what is wrong with them."""
    at = {n: _get(v, f"$.{n}", "variant") for n in fields}
    if plain:
        at[plain] = F.coalesce(at[plain], F.when(F.schema_of_variant(v) == "STRING", v))
    wrong = [F.concat(F.lit(f"{n}: "), f.check(at[n])) for n, f in fields.items()]
    return F.struct(*[f.read(at[n]).alias(n) for n, f in fields.items()]), F.array_compact(F.array(*wrong))


def _compiled(v: Column, name: str, field: Field | Items | Record) -> Column:
    """A field's values before what isn't kept goes: an array of (value, errors, kept)."""
    value = _get(v, f"$.{name}", "variant")
    if isinstance(field, Field):
        return F.array(F.struct(field.read(value).alias("value"), F.array_compact(F.array(F.concat(F.lit(f"{name}: "), field.check(value)))).alias("errors"), F.lit(True).alias("kept")))
    if isinstance(field, Record):
        made, wrong = _read(value, field.fields)
        return F.array(F.struct(made.alias("value"), F.transform(wrong, lambda e: F.concat(F.lit(f"{name}."), e)).alias("errors"), F.lit(True).alias("kept")))

    def item(x: Column, i: Column) -> Column:
        made, wrong = _read(x, field.fields, field.required if field.plain else None)
        place = F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
        kind = F.schema_of_variant(x)
        fits = kind.startswith("OBJECT") | ((kind == "STRING") if field.plain else F.lit(False))
        errors = F.when(fits, F.transform(wrong, lambda e: F.concat(place, F.lit("."), e))).otherwise(F.array(F.concat(place, F.lit(": no record"))))
        return F.struct(made.alias("value"), errors.alias("errors"), (fits & (made[field.required] != "")).alias("kept"))

    return F.transform(_list(value), item)


def coerced(replies: DataFrame, shape: Shape) -> DataFrame:
    """replies(id, reply) -> id, ok, a column for each field of the shape, errors.  Rows stay, repeated ids too."""
    read = replies.select("id", T.json_object(F.col("reply")).alias("__v"))
    object_ = F.when(F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False)), F.col("__v"))
    read = read.select("id", object_.isNotNull().alias("ok"), *[_compiled(object_, n, f).alias(n) for n, f in shape.items()])
    kept = lambda n: F.transform(F.filter(n, lambda x: x["kept"]), lambda x: x["value"])
    out = [(kept(n) if isinstance(f, Items) else F.element_at(n, 1)["value"]).alias(n) for n, f in shape.items()]
    return read.select("id", "ok", *out, F.flatten(F.concat(*[F.transform(n, lambda x: x["errors"]) for n in shape])).alias("errors"))


def problems(read: DataFrame) -> DataFrame:
    """id, error: a row for each error of coerced replies.  The outer explode keeps the
    planner from working the errors out once more, in a filter on their number."""
    return read.select("id", F.explode_outer("errors").alias("error")).where("error is not null")
