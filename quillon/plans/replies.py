"""Queries over replies of a model: one made by rule for every question of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import coercion as C
from quillon.operators.grounding import CATEGORIES, DECISIONS, KINDS
from quillon.plans import sql as Q
from quillon.plans.catalogue import query
from quillon.sources import tables as B

#: A reply; what stands between @ is SQL that Spark and DuckDB both read: ``x`` is the question as a JSON text, ``n`` its number.
_REPLY = """{"input_sufficient": @yes@, "clarifying_questions": [@x@, "", null, 0, @n@], "product_classification": @class@,
"registration_strategy": [@x@, {"text": "", "kind": "regulatory_risk"}, 7, {"kind": "@kind@", "text": @x@, "citation_ids": [@n % 9@, "@n % 4@", "x", -1]}, "  "],
"required_studies": [{"category": "@category@", "name": @x@, "citation_ids": [@n % 5@]}, {"name": ""}, "no"], "bioequivalence": @decision@, "regulatory_risks": @risks@,
"conflicts": [{"description": @x@, "citation_ids": [1, 2]}, {"description": null}], "limitations": null}"""


def _sql() -> str:
    """The reply as one expression."""
    pick = lambda values: f"CASE n % {len(values)} {' '.join(f'WHEN {k} THEN {Q.q(v)}' for k, v in enumerate(values))} END"
    parts = {
        "yes": pick(["true", "false", '"да"', "0", "null", "[]"]), "class": "CASE WHEN n % 3 = 0 THEN 'null' ELSE x END", "kind": pick([*KINDS, "odd"]), "category": pick([*[c.upper() for c in CATEGORIES], "other"]),
        "decision": f"""CASE WHEN n % 5 = 0 THEN '"required"' ELSE concat('{{"status": "', {pick([*[d.capitalize() for d in DECISIONS], "?"])}, '", "rationale": ', x, ', "conditions": [', x, ', ""], "citation_ids": ["', CAST(n % 6 AS STRING), '"]}}') END""",
        "risks": """CASE WHEN n % 2 = 0 THEN x ELSE concat('[', x, ', {"text": null}]') END""",
    }
    return "concat(" + ", ".join(Q.q(p) if k % 2 == 0 else f"CAST({parts.get(p, p)} AS STRING)" for k, p in enumerate(_REPLY.split("@"))) + ")"


#: Plain, fenced, among words, cut short.
_WRAPPED = "CASE n % 4 WHEN 0 THEN r WHEN 1 THEN concat('```json', chr(10), r, chr(10), '```') WHEN 2 THEN concat('вот: ', r, ' конец') ELSE CASE WHEN n % 8 = 3 THEN substring(r, 1, 40) ELSE r END END"


def replies(spark, sf):
    """id, reply"""
    b = B.read(spark, sf, "benchmark")
    j = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    d = b.select(F.col("item_id").alias("n"), F.substring(j, F.lit(9), F.length(j) - 9).alias("x"))
    return d.select("n", F.expr(_sql()).alias("r")).select(F.col("n").alias("id"), F.expr(_WRAPPED).alias("reply"))


def _string(v: str) -> str:
    return f"json_extract_string({v}, '$')"


def _filled(v: str) -> str:
    return f"coalesce(CASE json_type({v}) WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN {v}::VARCHAR = 'true' WHEN 'VARCHAR' THEN {_string(v)} <> '' WHEN 'ARRAY' THEN json_array_length({v}) > 0 WHEN 'OBJECT' THEN {v}::VARCHAR <> '{{}}' ELSE {v}::DOUBLE <> 0 END, false)"


def _list(v: str, path: str) -> str:
    return f"CASE WHEN json_type({v}, '$.{path}') = 'ARRAY' THEN json_extract({v}, '$.{path}[*]') ELSE []::JSON[] END"


def _ids(v: str) -> str:
    return f"array_to_string(list_filter(list_transform({_list(v, 'citation_ids')}, lambda i: {_string('i')}), lambda i: regexp_full_match(i, '[0-9]+')), '+')"


def _texts(v: str, path: str) -> str:
    return f"array_to_string(list_transform(list_filter({_list(v, path)}, lambda t: {_filled('t')}), lambda t: {_string('t')}), '+')"


def _known(said: str, values: list[str], other: str) -> str:
    return f"CASE WHEN list_contains([{', '.join(map(Q.q, values))}], {said}) THEN {said} ELSE {Q.q(other)} END"


def _body(s: str) -> str:
    return f"trim({s})"


def _statements(path: str, kind: str) -> str:
    said = f"{_body(f"CASE WHEN json_type(x) = 'VARCHAR' THEN {_string('x')} ELSE json_extract_string(x, '$.text') END")}"
    row = f"CASE WHEN {said} <> '' AND json_type(x) IN ('VARCHAR', 'OBJECT') THEN {_known("json_extract_string(x, '$.kind')", KINDS, kind)} || '|' || {said} || '|' || {_ids('x')} END"
    return f"array_to_string(list_filter(list_transform({_list('v', path)}, lambda x: {row}), lambda s: s IS NOT NULL), ';')"


def _decision(path: str) -> str:
    d = f"json_extract(v, '$.{path}')"
    return f"{_known(f"lower(json_extract_string(v, '$.{path}.status'))", DECISIONS, 'insufficient_data')} || '|' || coalesce(json_extract_string(v, '$.{path}.rationale'), '') || '|' || {_texts(d, 'conditions')} || '|' || {_ids(d)}"


Q.define("reply", (), f"SELECT n AS id, {_WRAPPED} AS reply FROM (SELECT n, {_sql()} AS r FROM (SELECT item_id AS n, to_json(coalesce(text, ''))::VARCHAR AS x FROM benchmark))")
_FENCED = r"regexp_extract(reply, '(?s)```(?:json)?\s*(.*?)```', 1)"
_OUTER = r"regexp_extract(s, '(?s)\{.*\}')"
Q.define("parsed", ("reply",), f"SELECT id, coalesce(try_cast(s AS JSON), try_cast(nullif({_OUTER}, '') AS JSON)) AS v FROM (SELECT id, {_body(f"coalesce(nullif({_FENCED}, ''), reply)")} AS s FROM reply)")


@query("t26_json_reply", "parsed", "SELECT id, v IS NOT NULL AS ok, len(json_keys(v)) AS n_keys, json_extract_string(v, '$.registration_strategy[3].text') AS text FROM parsed")
def _(spark, sf):
    v = replies(spark, sf).select("id", T.json_object(F.col("reply")).alias("v"))
    keys = F.map_keys(F.try_variant_get("v", "$", "map<string, variant>"))
    return v.select("id", F.col("v").isNotNull().alias("ok"), F.when(F.col("v").isNotNull(), F.size(keys)).cast("long").alias("n_keys"), F.try_variant_get("v", "$.registration_strategy[3].text", "string").alias("text"))


_STUDY = f"CASE WHEN coalesce(json_extract_string(x, '$.name'), '') <> '' AND json_type(x) = 'OBJECT' THEN {_known("lower(json_extract_string(x, '$.category'))", CATEGORIES, 'clinical')} || '|' || json_extract_string(x, '$.name') || '|' || {Q.q(C.NECESSITY)} || '|' || {_ids('x')} END"
_CONFLICT = f"CASE WHEN coalesce(json_extract_string(x, '$.description'), '') <> '' THEN json_extract_string(x, '$.description') || '|' || {_ids('x')} END"


def _rows(path: str, row: str) -> str:
    return f"array_to_string(list_filter(list_transform({_list('v', path)}, lambda x: {row}), lambda s: s IS NOT NULL), ';')"


@query("g15_coerced_reply", "parsed", f"""
SELECT id, v IS NOT NULL AS ok, {_filled("json_extract(v, '$.input_sufficient')")} AS input_sufficient, {_texts('v', 'clarifying_questions')} AS clarifying_questions, coalesce(json_extract_string(v, '$.product_classification'), '') AS product_classification,
 {_statements('registration_strategy', 'regulatory_interpretation')} AS registration_strategy, {_rows('required_studies', _STUDY)} AS required_studies, {_decision('bioequivalence')} AS bioequivalence, {_decision('biowaiver')} AS biowaiver,
 {_statements('regulatory_risks', 'regulatory_risk')} AS regulatory_risks, {_rows('conflicts', _CONFLICT)} AS conflicts, {_texts('v', 'limitations')} AS limitations FROM parsed""")
def _(spark, sf):
    """A whole assessment read from each reply; nested values as texts."""
    ids = lambda x: F.array_join(x["citation_ids"].cast("array<string>"), "+")
    told = lambda n, *names: F.array_join(F.transform(n, lambda x: F.concat_ws("|", *[x[c] for c in names], ids(x))), ";").alias(n)
    chosen = lambda n: F.concat_ws("|", F.col(n)["status"], F.col(n)["rationale"], F.array_join(F.col(n)["conditions"], "+"), ids(F.col(n))).alias(n)
    return C.coerced(replies(spark, sf), C.ASSESSMENT).select(
        "id", "ok", "input_sufficient", F.array_join("clarifying_questions", "+").alias("clarifying_questions"), "product_classification", told("registration_strategy", "kind", "text"),
        told("required_studies", "category", "name", "necessity"), chosen("bioequivalence"), chosen("biowaiver"), told("regulatory_risks", "kind", "text"), told("conflicts", "description"), F.array_join("limitations", "+").alias("limitations"),
    )


def _blank(path: str) -> str:
    said = f"CASE WHEN json_type(x) = 'VARCHAR' THEN {_string('x')} ELSE coalesce(json_extract_string(x, '$.text'), '') END"
    return f"list_filter(list_transform({_list('v', path)}, lambda x, i: CASE WHEN json_type(x) IN ('VARCHAR', 'OBJECT') AND {_body(said)} = '' THEN '{path}[' || (i - 1) || '].text: empty' END), lambda s: s IS NOT NULL)"


@query("g16_empty_statements", "parsed", f"SELECT id, unnest(list_concat({_blank('registration_strategy')}, {_blank('regulatory_risks')})) AS error FROM parsed")
def _(spark, sf):
    """The statements of an assessment that have no text, by their place."""
    return C.problems(C.coerced(replies(spark, sf), C.ASSESSMENT)).where(F.col("error").endswith(".text: empty"))
