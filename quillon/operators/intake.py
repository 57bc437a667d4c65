"""Profiles and intents from free text, and the queries they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import inn as N
from quillon.functions.text import BLANK, trimmed

# Fixed values, in order: the first needle found decides.
FORMS = [("таблетк", "таблетки"), ("капсул", "капсулы"), ("суспенз", "суспензия"), ("сироп", "сироп"), ("раствор для инъекц", "раствор для инъекций"), ("раствор для инфуз", "раствор для инфузий"), ("лиофилизат", "лиофилизат"), ("порошок", "порошок"), ("гранул", "гранулы"), ("суппозитор", "суппозитории"), ("мазь", "мазь"), ("крем", "крем"), ("гель", "гель"), ("пластыр", "трансдермальный пластырь"), ("спрей", "спрей"), ("аэрозол", "аэрозоль"), ("капл", "капли"), ("раствор", "раствор")]
ROUTES = [("перорал", "пероральный"), ("внутрь", "пероральный"), ("внутривен", "внутривенный"), ("внутримышеч", "внутримышечный"), ("подкожн", "подкожный"), ("ингаляц", "ингаляционный"), ("накожн", "накожный"), ("наружн", "наружный"), ("трансдермал", "трансдермальный"), ("ректал", "ректальный"), ("вагинал", "вагинальный"), ("офтальм", "офтальмологический"), ("интраназал", "интраназальный"), ("сублингвал", "сублингвальный")]
KINDS = [("воспроизвед", "generic"), ("генерик", "generic"), ("дженерик", "generic"), ("generic", "generic"), ("гибридн", "hybrid"), ("hybrid", "hybrid"), ("биоаналог", "biosimilar"), ("биоподобн", "biosimilar"), ("biosimilar", "biosimilar"), ("биологическ", "biological"), ("biological", "biological"), ("оригинальн", "original"), ("референтн препарат разраб", "original"), ("original", "original"), ("хорошо изученн", "well_established_use"), ("well.established", "well_established_use"), ("комбинированн", "combination"), ("фиксированн комбинац", "combination")]
RELEASES = [("немедленн", "immediate"), ("immediate", "immediate"), ("отсроченн", "delayed"), ("кишечнораствор", "delayed"), ("delayed", "delayed"), ("пролонгированн", "prolonged"), ("продлённ", "prolonged"), ("prolonged", "prolonged"), ("модифицированн", "modified"), ("modified", "modified")]
KIND_LABELS = {"original": "оригинальный (референтный)", "generic": "воспроизведённый (генерик)", "hybrid": "гибридный", "well_established_use": "с хорошо изученным применением", "biological": "биологический", "biosimilar": "биоаналоговый (биоподобный)", "combination": "комбинированный", "unknown": "не определён"}
RELEASE_LABELS = {"immediate": "немедленное высвобождение", "modified": "модифицированное высвобождение", "delayed": "отсроченное (кишечнорастворимое) высвобождение", "prolonged": "пролонгированное высвобождение", "unknown": "не указан"}
NOT_INN = ["препарат", "лекарственный", "таблетки", "капсулы", "раствор", "воспроизведенный", "оригинальный", "регистрация", "исследование", "биоэквивалентность", "мнн", "дозировка", "форма", "введения", "высвобождение"]
ADVICE = ["какую дозу мне принимать", "можно ли мне принимать", "как лечить", "поставь диагноз", "назначь лечение", "мне плохо"]
REGULATORY = ["регистрац", "экспертиз", "досье", "биоэквивалент", "биовейвер", "biowaiver", "референтн", "исследован", "клиническ", "доклиническ", "gcp", "glp", "gmp", "фармаконадзор", "охлп", "инструкц", "стабильн", "валидац", "спецификац", "примес", "биоаналог", "биоподобн", "иммуноген", "лекарств", "препарат", "дозировк", "высвобожден", "фармакокинет", "auc", "cmax", "модуль", "надлежащей практики", "еаэс", "решени", "приложени", "пункт"]
LOOKUP = r"(?iu)текст|скачать|где найти|дай ссылку|покажи документ|решение[ \t\n\r\f\x0B]*№|рекомендаци[яю][ \t\n\r\f\x0B]*№"
STRENGTH = r"(?iU)\b[0-9]+(?:[.,][0-9]+)?\s*(?:мг|мкг|г|ме|ед|ммоль)(?:\s*/\s*(?:мл|г|доза|таблетк\w*))?"
VARIABLE = rf"(?iu)высоковариабельн|highly{BLANK}+variable"
NARROW = rf"(?iu)узк(?:им|ий|ого){BLANK}+терапевтическ|narrow{BLANK}+therapeutic"
LABELS = ["мнн", "международное непатентованное наименование", "лекарственная форма", "дозировка", "путь введения", "тип препарата", "категория препарата", "характер высвобождения", "высвобождение", "референтный препарат"]
REQUIRED = ["inn", "dosage_form", "strength", "route_of_administration", "product_type", "release_type"]
ASK_ORDER = ["product_type", "dosage_form", "release_type", "strength", "route_of_administration", "inn"]
ASK = {
    "inn": "международное непатентованное наименование (МНН) действующего вещества", "dosage_form": "лекарственную форму", "strength": "дозировку (силу действия)", "route_of_administration": "путь введения",
    "product_type": "тип препарата (оригинальный, воспроизведённый, гибридный, биологический, биоаналоговый, комбинированный)", "release_type": "характер высвобождения (немедленное / модифицированное)",
}
ASK_REFERENCE = "Выбран ли референтный лекарственный препарат и на основании чего?"
# Search formulations by rule.
BY_KIND = [
    ("generic", "требования к регистрационному досье воспроизведённого лекарственного препарата, подтверждение эквивалентности референтному препарату"),
    ("generic", "исследование биоэквивалентности воспроизведённого лекарственного препарата, дизайн исследования, доверительный интервал 90%"),
    ("generic", "условия освобождения от исследования биоэквивалентности, биовейвер на основе биофармацевтической классификационной системы BCS"),
    ("generic", "выбор референтного лекарственного препарата для исследования биоэквивалентности"),
    ("hybrid", "гибридный лекарственный препарат, объём собственных исследований, отличия от референтного препарата"),
    ("biological", "требования к исследованиям биологических лекарственных препаратов, биоаналоговый (биоподобный) лекарственный препарат, сравнительные исследования, иммуногенность"),
    ("biosimilar", "требования к исследованиям биологических лекарственных препаратов, биоаналоговый (биоподобный) лекарственный препарат, сравнительные исследования, иммуногенность"),
    ("original", "объём доклинических и клинических исследований оригинального лекарственного препарата, регистрационное досье, модуль 4 и модуль 5"),
    ("well_established_use", "хорошо изученное медицинское применение, библиографические данные вместо собственных исследований"),
    ("combination", "комбинированный лекарственный препарат с фиксированной комбинацией действующих веществ, обоснование комбинации, объём исследований"),
    ("unknown", "порядок регистрации и экспертизы лекарственного препарата, состав регистрационного досье"),
]
BY_FLAG = [
    ("modified", "лекарственные препараты с модифицированным высвобождением, исследования биоэквивалентности, однократный и многократный приём"),
    ("strengths", "дополнительные дозировки лекарственного препарата, освобождение от исследования биоэквивалентности для дополнительных дозировок, пропорциональность состава"),
    ("variable", "высоковариабельные лекарственные препараты, расширение границ приемлемости, репликативный дизайн исследования"),
    ("narrow", "лекарственные препараты с узким терапевтическим диапазоном, суженные границы биоэквивалентности"),
    ("indication", "регистрация нового показания к применению"),
    ("form", "регистрация новой лекарственной формы"),
]


def first_match(text: Column, table: list[tuple[str, str]], pattern: bool = False, default: str = "") -> Column:
    """The value of the first needle in the text, in table order."""
    out = None
    for needle, value in table:
        hit = text.rlike(needle) if pattern else F.contains(text, F.lit(needle))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def labelled(text: Column) -> Column:
    """Map from label (lower case) to value of the ``label: value`` lines; the last of a label wins."""
    names = "|".join(sorted(LABELS, key=len, reverse=True))
    rule = rf"(?imu)^[ \t]*({names})[ \t]*[:\-–][ \t]*(\S.*)$"
    keys = F.regexp_extract_all(text, F.lit(rule), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(rule), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.transform(pairs, lambda p: F.struct(F.lower(p["k"]).alias("k"), trimmed(p["v"]).alias("v")))


def _label(pairs: Column, *names: str) -> Column:
    """The last value of the first of the labels that has one."""
    last = lambda n: F.try_element_at(F.filter(pairs, lambda p: p["k"] == n), F.lit(-1))["v"]
    return F.coalesce(*[F.nullif(last(n), F.lit("")) for n in names], F.lit(""))


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, r"^[ .;]+|[ .;]+$", "")


def guess_inn(text: Column, detected: Column) -> Column:
    """A detected name, or the one plausible word of a text of four words or fewer."""
    words = F.regexp_extract_all(text, F.lit("[А-Яа-яЁё]{5,30}"), F.lit(0))
    good = F.filter(words, lambda w: ~F.translate(F.lower(w), "ё", "е").isin(NOT_INN))
    short = F.size(F.filter(F.split(trimmed(text), rf"{BLANK}+"), lambda w: w != "")) <= 4
    return F.coalesce(F.try_element_at(detected, F.lit(1)), F.when(short & (F.size(good) == 1), F.lower(good[0])), F.lit(""))


def profiles(messages: DataFrame, known: DataFrame) -> DataFrame:
    """messages(id, text) -> the product profile said in each: labelled lines first, then vocabulary."""
    found = messages.join(N.detect(messages, "id", "text", known), "id")
    low = F.translate(F.lower(F.col("text")), "ё", "е")
    m = found.withColumn("pairs", labelled(F.col("text"))).withColumn("low", low)
    p = F.col("pairs")
    strength = _bare(_label(p, "дозировка"))
    kind_text, release_text = F.lower(_label(p, "тип препарата", "категория препарата")), F.lower(_label(p, "характер высвобождения", "высвобождение"))
    reference = _label(p, "референтный препарат")
    pick = lambda said: F.when(said != "", said).otherwise(F.col("low"))
    m = m.select(
        "id", F.col("text").alias("free_text"),
        F.coalesce(F.nullif(_bare(_label(p, "мнн", "международное непатентованное наименование")), F.lit("")), guess_inn(F.col("text"), F.col("inns"))).alias("inn"),
        F.coalesce(F.nullif(_bare(_label(p, "лекарственная форма")), F.lit("")), first_match(F.col("low"), FORMS)).alias("dosage_form"),
        F.coalesce(F.nullif(strength, F.lit("")), trimmed(F.regexp_extract("text", STRENGTH, 0))).alias("strength"),
        F.coalesce(F.nullif(_bare(_label(p, "путь введения")), F.lit("")), first_match(F.col("low"), ROUTES)).alias("route_of_administration"),
        first_match(pick(kind_text), KINDS, True, "unknown").alias("product_type"),
        first_match(pick(release_text), RELEASES, False, "unknown").alias("release_type"),
        F.when(F.lower(reference).isin("", "не выбран", "нет", "-", "—"), "").otherwise(_bare(reference)).alias("reference_product"),
        F.when(F.col("text").rlike(VARIABLE), True).alias("highly_variable"), F.when(F.col("text").rlike(NARROW), True).alias("narrow_therapeutic_index"),
    )
    kind = F.col("product_type")
    return m.withColumns({
        "biological": F.when(kind.isin("biological", "biosimilar"), True), "biosimilar": F.when(kind.isin("biological", "biosimilar"), kind == "biosimilar"),
        "combination_product": F.when(kind == "combination", True),
    })


def missing_fields() -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")).isin("", "unknown"), c) for c in REQUIRED]))


def clarifying_questions() -> Column:
    """Questions for what is missing, the most deciding first."""
    asked = F.array_compact(F.array(*[F.when(F.array_contains(missing_fields(), c), f"Укажите {ASK[c]}.") for c in ASK_ORDER]))
    open_ = (F.col("reference_product") == "") & F.col("product_type").isin("generic", "hybrid", "biosimilar", "unknown")
    return F.when(open_, F.concat(asked, F.array(F.lit(ASK_REFERENCE)))).otherwise(asked)


def product_specific() -> Column:
    return (F.col("inn") != "") | (F.col("dosage_form") != "") | (F.col("product_type") != "unknown") | (F.col("release_type") != "unknown")


def intent() -> Column:
    low = F.translate(F.lower(F.col("free_text")), "ё", "е")
    any_of = lambda words: low.rlike("|".join(words))
    return (
        F.when(any_of(ADVICE), "out_of_scope")
        .when(F.col("free_text").rlike(LOOKUP) & ~product_specific(), "document_lookup")
        .when(product_specific(), "product_assessment")
        .otherwise("general_regulatory")
    )


def on_topic() -> Column:
    """Whether a general question has the subject's words."""
    return F.translate(F.lower(F.col("free_text")), "ё", "е").rlike("|".join(REGULATORY))


def _map(labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])


def description() -> Column:
    """What was declared, in one line, with notes."""
    kind, release = _map(KIND_LABELS)[F.col("product_type")], _map(RELEASE_LABELS)[F.col("release_type")]
    parts = F.concat_ws(", ", F.concat(F.lit("Заявлен как "), kind), F.when(F.col("dosage_form") != "", F.concat(F.lit("лекарственная форма — "), F.col("dosage_form"))), F.when(F.col("release_type") != "unknown", release), F.when(F.col("route_of_administration") != "", F.concat(F.lit("путь введения — "), F.col("route_of_administration"))))
    notes = [
        F.when(F.col("product_type") == "biosimilar", "Биоаналоговый препарат по определению относится к биологическим лекарственным препаратам."),
        F.when((F.col("product_type") == "generic") & (F.col("reference_product") == ""), "Референтный лекарственный препарат не указан."),
        F.when(F.col("highly_variable"), "Пользователь указал на высокую вариабельность препарата."),
        F.when(F.col("narrow_therapeutic_index"), "Пользователь указал на узкий терапевтический диапазон."),
    ]
    unknown = "Категория препарата не определена по введённым данным. Без указания типа препарата регистрационная стратегия не может быть определена."
    return F.when(F.col("product_type") == "unknown", unknown).otherwise(F.concat_ws(". ", parts, *notes))


def needs_clarification() -> Column:
    return ~((F.col("inn") != "") | ((F.col("dosage_form") != "") & (F.col("strength") != "")))


def summary_lines() -> Column:
    said = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—")))
    reference = F.concat(F.lit("Референтный препарат: "), F.coalesce(F.nullif(F.col("reference_product"), F.lit("")), F.lit("не указан")))
    return F.array(
        said("МНН", "inn"), said("Лекарственная форма", "dosage_form"), said("Дозировка", "strength"), said("Путь введения", "route_of_administration"),
        F.concat(F.lit("Категория препарата: "), _map(KIND_LABELS)[F.col("product_type")]), F.concat(F.lit("Характер высвобождения: "), _map(RELEASE_LABELS)[F.col("release_type")]), reference,
    )


def valid_form() -> Column:
    """At least one of name, form, strength and free text."""
    filled = [trimmed(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("inn", "dosage_form", "strength", "free_text")]
    return filled[0] | filled[1] | filled[2] | filled[3]


def inn_queries(name: Column) -> Column:
    spelled = F.slice(F.filter(N.variants(name), lambda v: F.length(v) >= 5), 1, 2)
    plain = F.transform(spelled, lambda v: F.concat(v, F.lit(" исследование биоэквивалентности референтный лекарственный препарат")))
    chosen = F.coalesce(F.nullif(N.canonical(name), F.lit("")), name)
    return F.concat(plain, F.array(F.concat(F.lit("рекомендация Экспертного комитета о выборе референтного лекарственного препарата с МНН «"), chosen, F.lit("»"))))


def profile_queries() -> Column:
    """Search formulations of a profile: what it says, rules by type and flags, its substance."""
    empty = F.array().cast("array<string>")
    label = lambda labels, c: F.coalesce(_map(labels)[F.col(c)], F.lit(""))
    base = F.array_join(F.filter(F.array(F.col("inn"), F.col("dosage_form"), F.col("strength"), F.col("route_of_administration"), label(KIND_LABELS, "product_type"), label(RELEASE_LABELS, "release_type")), lambda x: x != ""), " ")
    flags = {
        "modified": F.col("release_type").isin("modified", "prolonged", "delayed"), "strengths": F.coalesce(F.col("additional_strengths"), F.lit("")) != "", "variable": F.col("highly_variable"),
        "narrow": F.col("narrow_therapeutic_index"), "indication": F.col("new_indication"), "form": F.col("new_dosage_form"),
    }
    rules = [F.when(F.col("product_type") == k, q) for k, q in BY_KIND] + [F.when(flags[k], q) for k, q in BY_FLAG]
    every = F.concat(F.array(base), F.array_compact(F.array(*rules)), F.when(F.col("inn") != "", inn_queries(F.col("inn"))).otherwise(empty))
    return F.array_distinct(F.filter(every, lambda q: q != ""))


def chat_queries() -> Column:
    empty = F.array().cast("array<string>")
    every = F.concat(F.array(trimmed(F.col("free_text"))), F.when(F.col("inn") != "", inn_queries(F.col("inn"))).otherwise(empty))
    return F.array_distinct(F.filter(every, lambda q: q != ""))
