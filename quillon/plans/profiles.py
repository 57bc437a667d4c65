"""Queries over what applicants say: every turn of ``conversations`` behind a message, and
names in different spellings, with one SQL twin of the profile for all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import inn as N
from quillon.functions import text as T
from quillon.operators import intake as I
from quillon.plans import sql as Q
from quillon.plans.catalogue import _STRENGTH, _named, _said, query


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^[ .;]+|[ .;]+$', '', 'g')"


def _map(labels: dict[str, str], x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {Q.q(k)} THEN {Q.q(v)}" for k, v in labels.items()) + " END"


def _in(x: str, values: list[str]) -> str:
    return f"{x} IN ({', '.join(map(Q.q, values))})"


def _found(x: str, rule: str) -> str:
    return f"regexp_matches({x}, {Q.q(rule.removeprefix('(?iu)'))}, 'i')"


def _last(*labels: str) -> str:
    """The last value of the first of the labels that has one."""
    return "coalesce(" + ", ".join(f"nullif(list_reverse(vs)[list_position(list_reverse(ks), {Q.q(n)})], '')" for n in labels) + ", '')"


def _in_order(l: str) -> str:
    """A list without repeats; the first of each stays where it is."""
    return f"list_filter({l}, lambda s, i: list_position({l}, s) = i)"


_RULE = Q.q(rf"(?im)^[ \t]*({'|'.join(sorted(I.LABELS, key=len, reverse=True))})[ \t]*[:\-–][ \t]*([^ \t\n\r\f\x0B].*)$")
Q.define("labelled", ("said",), f"SELECT id, text, {Q.low('text')} AS low, list_transform(regexp_extract_all(text, {_RULE}, 1), lambda k: lower(k)) AS ks, list_transform(regexp_extract_all(text, {_RULE}, 2), lambda v: {Q.trim('v')}) AS vs FROM said")
Q.define("detected", ("said", "spelled"), f"SELECT s.id, min(name) AS first_name FROM said s JOIN spelled p ON contains({Q.folded('s.text')}, p.spelling) GROUP BY s.id")
_KIND, _RELEASE, _REFERENCE = (f"lower({_last('тип препарата', 'категория препарата')})", f"lower({_last('характер высвобождения', 'высвобождение')})", _last("референтный препарат"))
_GOOD = f"list_filter(regexp_extract_all(text, '[А-Яа-яЁё]{{5,30}}'), lambda w: NOT {_in(Q.low('w'), I.NOT_INN)})"
_SHORT = f"len(list_filter(string_split_regex({Q.trim('text')}, '{T.BLANK}+'), lambda w: w <> '')) <= 4"
Q.define("prof", ("labelled", "detected"), f"""
SELECT id, text AS free_text, low, coalesce(nullif({_bare(_last('мнн', 'международное непатентованное наименование'))}, ''), first_name, CASE WHEN {_SHORT} AND len({_GOOD}) = 1 THEN lower({_GOOD}[1]) END, '') AS inn,
 coalesce(nullif({_bare(_last('лекарственная форма'))}, ''), {Q.case(I.FORMS, 'low', '')}) AS dosage_form, coalesce(nullif({_bare(_last('дозировка'))}, ''), {Q.trim(f"regexp_extract(text, {Q.q(_STRENGTH)}, 1, 'i')")}) AS strength,
 coalesce(nullif({_bare(_last('путь введения'))}, ''), {Q.case(I.ROUTES, 'low', '')}) AS route_of_administration, {Q.case(I.KINDS, f"coalesce(nullif({_KIND}, ''), low)", 'unknown', True)} AS product_type,
 {Q.case(I.RELEASES, f"coalesce(nullif({_RELEASE}, ''), low)", 'unknown')} AS release_type, CASE WHEN {_in(f'lower({_REFERENCE})', ['', 'не выбран', 'нет', '-', '—'])} THEN '' ELSE {_bare(_REFERENCE)} END AS reference_product,
 CASE WHEN {_found('text', I.VARIABLE)} THEN true END AS highly_variable, CASE WHEN {_found('text', I.NARROW)} THEN true END AS narrow_therapeutic_index FROM labelled LEFT JOIN detected USING (id)""")
_FIELDS = ["inn", "dosage_form", "strength", "route_of_administration", "product_type", "release_type", "reference_product"]


def _profiles(spark, sf):
    return I.profiles(_said(spark, sf), N.vocabulary(spark))


@query("t23_labelled_fields", "labelled", "SELECT id, array_to_string(list_transform(ks, lambda k, i: k || '=' || vs[i]), ';') AS fields FROM labelled WHERE len(ks) > 0")
def _(spark, sf):
    f = _said(spark, sf).select("id", I.labelled(F.col("text")).alias("f")).where("size(f) > 0")
    return f.select("id", F.array_join(F.transform("f", lambda x: F.concat(x["k"], F.lit("="), x["v"])), ";").alias("fields"))


@query("c1_profiles", "prof", f"SELECT id, {', '.join(_FIELDS)}, highly_variable, narrow_therapeutic_index FROM prof")
def _(spark, sf):
    return _profiles(spark, sf).select("id", *_FIELDS, "highly_variable", "narrow_therapeutic_index")


@query("c3_inn_guess", "prof", "SELECT id, inn FROM prof")
def _(spark, sf):
    return _profiles(spark, sf).select("id", "inn")


_MISSING = "list_filter([" + ", ".join(f"CASE WHEN {_in(c, ['', 'unknown'])} THEN '{c}' END" for c in I.REQUIRED) + "], lambda c: c IS NOT NULL)"
_ASKED = "list_filter([" + ", ".join(f"CASE WHEN {_in(c, ['', 'unknown'])} THEN {Q.q(f'Укажите {I.ASK[c]}.')} END" for c in I.ASK_ORDER) + f", CASE WHEN reference_product = '' AND {_in('product_type', ['generic', 'hybrid', 'biosimilar', 'unknown'])} THEN {Q.q(I.ASK_REFERENCE)} END], lambda c: c IS NOT NULL)"


@query("g17_sufficiency", "prof", f"SELECT id, array_to_string({_MISSING}, ',') AS missing FROM prof")
def _(spark, sf):
    return _profiles(spark, sf).select("id", F.array_join(I.missing_fields(), ",").alias("missing"))


@query("c4_clarifying_questions", "prof", f"SELECT id, array_to_string({_ASKED}, chr(10)) AS questions FROM prof")
def _(spark, sf):
    return _profiles(spark, sf).select("id", F.array_join(I.clarifying_questions(), "\n").alias("questions"))


_SPECIFIC = "(inn <> '' OR dosage_form <> '' OR product_type <> 'unknown' OR release_type <> 'unknown')"


@query("c5_intent", "prof", f"SELECT id, CASE WHEN regexp_matches(low, {Q.q('|'.join(I.ADVICE))}) THEN 'out_of_scope' WHEN {_found('free_text', I.LOOKUP)} AND NOT {_SPECIFIC} THEN 'document_lookup' WHEN {_SPECIFIC} THEN 'product_assessment' ELSE 'general_regulatory' END AS intent FROM prof")
def _(spark, sf):
    return _profiles(spark, sf).select("id", I.intent().alias("intent"))


_TOLD = f"concat_ws(', ', 'Заявлен как ' || {_map(I.KIND_LABELS, 'product_type')}, CASE WHEN dosage_form <> '' THEN 'лекарственная форма — ' || dosage_form END, CASE WHEN release_type <> 'unknown' THEN {_map(I.RELEASE_LABELS, 'release_type')} END, CASE WHEN route_of_administration <> '' THEN 'путь введения — ' || route_of_administration END)"
_NOTES = """CASE WHEN product_type = 'biosimilar' THEN 'Биоаналоговый препарат по определению относится к биологическим лекарственным препаратам.' END, CASE WHEN product_type = 'generic' AND reference_product = '' THEN 'Референтный лекарственный препарат не указан.' END,
 CASE WHEN highly_variable THEN 'Пользователь указал на высокую вариабельность препарата.' END, CASE WHEN narrow_therapeutic_index THEN 'Пользователь указал на узкий терапевтический диапазон.' END"""


@query("c6_description", "prof", f"SELECT id, CASE WHEN product_type = 'unknown' THEN 'Категория препарата не определена по введённым данным. Без указания типа препарата регистрационная стратегия не может быть определена.' ELSE concat_ws('. ', {_TOLD}, {_NOTES}) END AS description FROM prof")
def _(spark, sf):
    return _profiles(spark, sf).select("id", I.description().alias("description"))


@query("c7_clarification_gate", "prof", f"SELECT id, NOT (inn <> '' OR (dosage_form <> '' AND strength <> '')) AS ask, (inn <> '' OR dosage_form <> '' OR strength <> '' OR {Q.trim('free_text')} <> '') AS valid FROM prof")
def _(spark, sf):
    return _profiles(spark, sf).select("id", I.needs_clarification().alias("ask"), I.valid_form().alias("valid"))


@query("c9_valid_forms", "prof", f"SELECT id, inn, dosage_form, strength FROM prof WHERE inn <> '' OR dosage_form <> '' OR strength <> '' OR {Q.trim('free_text')} <> ''")
def _(spark, sf):
    """Forms with something filled in."""
    return _profiles(spark, sf).where(I.valid_form()).select("id", "inn", "dosage_form", "strength")


_LINES = ", ".join(f"'{label}: ' || coalesce(nullif({c}, ''), '—')" for label, c in (("МНН", "inn"), ("Лекарственная форма", "dosage_form"), ("Дозировка", "strength"), ("Путь введения", "route_of_administration")))


@query("c8_summary", "prof", f"SELECT id, array_to_string([{_LINES}, 'Категория препарата: ' || {_map(I.KIND_LABELS, 'product_type')}, 'Характер высвобождения: ' || {_map(I.RELEASE_LABELS, 'release_type')}, 'Референтный препарат: ' || coalesce(nullif(reference_product, ''), 'не указан')], chr(10)) AS summary FROM prof")
def _(spark, sf):
    return _profiles(spark, sf).select("id", F.array_join(I.summary_lines(), "\n").alias("summary"))


# Spellings, and the searches for a substance.

_ALIAS = "MAP {" + ", ".join(f"{Q.q(o)}: {Q.q(n)}" for n, others in N.ALIASES.items() for o in others) + "}"
_OTHERS = "MAP {" + ", ".join(f"{Q.q(n)}: [{', '.join(map(Q.q, others))}]" for n, others in N.ALIASES.items()) + "}"


def _spellings(name: str, of: str, key: str) -> str:
    """key, v, canonical, variants of a column's names."""
    cyrillic = "regexp_matches(v, '[а-яё]')"
    both = f"SELECT {key}, v, {cyrillic} AS own, {_ALIAS}[v] AS russian, {Q.to_latin('v')} AS latin, {Q.to_cyrillic('v')} AS cyr FROM (SELECT {key}, {Q.folded(name)} AS v FROM {of})"
    every = f"SELECT *, CASE WHEN own THEN list_concat([v, latin], coalesce({_OTHERS}[v], [])) ELSE list_concat([v, cyr], CASE WHEN russian IS NOT NULL THEN list_concat([russian], {_OTHERS}[russian]) ELSE [] END) END AS l FROM ({both})"
    stems = f"SELECT *, list_filter(list_transform(list_concat(l, list_transform(list_filter(l, lambda x: length(x) > 7 AND NOT contains(x, ' ')), lambda x: substr(x, 1, length(x) - 2))), lambda x: {Q.trim('x')}), lambda x: x <> '') AS m FROM ({every})"
    return f"SELECT {key}, v, CASE WHEN v = '' THEN '' WHEN own THEN v ELSE coalesce(russian, cyr) END AS canonical, CASE WHEN v = '' THEN [] ELSE {_in_order('m')} END AS variants FROM ({stems})"


Q.define("spelt", ("named",), f"SELECT document_id, CASE document_id % 3 WHEN 0 THEN name WHEN 1 THEN upper({Q.to_latin('name')}) ELSE ' Ново ' || name END AS name FROM named")
Q.define("spellings", ("spelt",), _spellings("name", "spelt", "document_id"))


def _spelt(spark, sf):
    """Every document's name as it is, in Latin capitals, or behind a word."""
    name, third = F.col("name"), F.col("document_id") % 3
    return _named(spark, sf).select("document_id", F.when(third == 0, name).when(third == 1, F.upper(N.to_latin(name))).otherwise(F.concat(F.lit(" Ново "), name)).alias("name"))


@query("t16_variants", "spellings", "SELECT document_id, array_to_string(variants, ',') AS variants FROM spellings")
def _(spark, sf):
    return _spelt(spark, sf).select("document_id", F.array_join(N.variants(F.col("name")), ",").alias("variants"))


@query("t17_canonical", "spellings", "SELECT document_id, canonical FROM spellings")
def _(spark, sf):
    return _spelt(spark, sf).select("document_id", N.canonical(F.col("name")).alias("canonical"))


Q.define("prof_names", ("prof",), _spellings("inn", "prof", "id"))
_SEARCHES = "CASE WHEN inn <> '' THEN list_concat(list_transform(list_filter(variants, lambda s: length(s) >= 5)[1:2], lambda s: s || ' исследование биоэквивалентности референтный лекарственный препарат'), ['рекомендация Экспертного комитета о выборе референтного лекарственного препарата с МНН «' || coalesce(nullif(canonical, ''), inn) || '»']) ELSE [] END"
_BASE = f"array_to_string(list_filter([inn, dosage_form, strength, route_of_administration, coalesce({_map(I.KIND_LABELS, 'product_type')}, ''), coalesce({_map(I.RELEASE_LABELS, 'release_type')}, '')], lambda s: s <> ''), ' ')"
_FLAGS = {"modified": "release_type IN ('modified', 'prolonged', 'delayed')", "strengths": "false", "variable": "highly_variable", "narrow": "narrow_therapeutic_index", "indication": "id % 2 = 0", "form": "false"}
_RULES = ", ".join([f"CASE WHEN product_type = {Q.q(k)} THEN {Q.q(v)} END" for k, v in I.BY_KIND] + [f"CASE WHEN {_FLAGS[k]} THEN {Q.q(v)} END" for k, v in I.BY_FLAG])


def _numbered(l: str) -> str:
    kept = _in_order("l")
    return f"SELECT id, generate_subscripts({kept}, 1) - 1 AS no, unnest({kept}) AS query FROM (SELECT id, list_filter({l}, lambda s: s IS NOT NULL AND s <> '') AS l FROM prof JOIN prof_names USING (id))"


@query("f15_profile_queries", "prof prof_names", _numbered(f"list_concat([{_BASE}], [{_RULES}], {_SEARCHES})"))
def _(spark, sf):
    """Each second profile asks for a new indication."""
    more = {"additional_strengths": F.lit(""), "new_indication": F.col("id") % 2 == 0, "new_dosage_form": F.lit(None).cast("boolean")}
    return _profiles(spark, sf).withColumns(more).select("id", F.posexplode(I.profile_queries()).alias("no", "query"))


@query("f17_chat_queries", "prof prof_names", _numbered(f"list_concat([{Q.trim('free_text')}], {_SEARCHES})"))
def _(spark, sf):
    return _profiles(spark, sf).select("id", F.posexplode(I.chat_queries()).alias("no", "query"))
