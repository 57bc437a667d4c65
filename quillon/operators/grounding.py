"""Citations, validation against them, conflicts and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T

# Labels and notes.
TIER_LABELS = {
    "TIER_1": "Обязательный нормативный акт ЕАЭС",
    "TIER_2": "Руководство/рекомендация ЕЭК",
    "TIER_3": "Рекомендация Экспертного комитета ЕЭК",
    "TIER_4": "Дополнительный международный источник (не обязателен в ЕАЭС)",
    "TIER_5": "Научный источник (не нормативный)",
}
OTHER_TIER = "Источник"
STATUS_LABELS = {
    "active": "действует",
    "amended": "действует с изменениями",
    "superseded": "утратил силу / заменён",
    "expired": "истёк срок действия",
    "unknown": "статус не подтверждён автоматически",
}
OTHER_STATUS = "статус неизвестен"
VERSION_LABELS = {
    "consolidated": "консолидированная редакция источника",
    "original_with_known_amendments": "первоначальная редакция; известны акты о внесении изменений",
    "requires_expert_validation": "действующая редакция не подтверждена автоматически — требуется экспертная проверка",
}
UNCITED = "[без прямой нормативной ссылки в найденном контексте] "
ONLY_REFERENCE = "[основано только на справочных источниках, не на обязательном акте ЕАЭС] "
NO_BASIS = "Вывод не подтверждён найденными нормативными фрагментами, поэтому категорический ответ не формируется. "
REMOVED = "Из ответа удалены несуществующие ссылки на источники: "
ABSENT = "В тексте ответа упомянуты номера актов, отсутствующие в найденном контексте: "
TO_CHECK = ". Эти упоминания требуют экспертной проверки."
BARE = "Утверждений без нормативной ссылки: "
MARKED = ". Они помечены как интерпретация, а не как требование."
EMPTY_ASSESSMENT = "Достаточное нормативное основание в доступной базе знаний не найдено — выводы носят исключительно ориентировочный характер."
EMPTY_ANSWER = "Достаточное нормативное основание в доступной базе знаний не найдено."
FRAGMENT, BEGINS, ENDS = "ФРАГМЕНТ", "НАЧАЛО", "КОНЕЦ"
SOURCE, STATUS, TEXT = "    источник: ", "    статус: ", "    текст:"
CARD_LIST = "\n**Документы по теме запроса, текст которых не проиндексирован**\n\nЭти документы найдены в реестре, но опубликованы как сканы без текстового слоя, поэтому их положения не могут быть процитированы системой. Их следует открыть вручную:\n\n"
KINDS = ["normative_requirement", "regulatory_interpretation", "regulatory_risk", "potential_authority_question", "insufficient_basis"]
DECISIONS = ["required", "not_required", "possible", "insufficient_data", "no_legal_basis_found"]
CATEGORIES = ["pharmaceutical", "nonclinical", "clinical"]
WEIGHTS = {"any": 0.20, "binding": 0.25, "several": 0.10, "cited": 0.20, "strength": 0.10, "confirmed": 0.10, "expert": 0.05, "conflict": 0.15, "superseded": 0.15, "supplementary": 0.25, "input": 0.20}
HIGH, MEDIUM = 0.7, 0.45


def binding_eaeu() -> Column:
    return (F.col("source_authority") == "EAEU") & F.col("source_tier").isin("TIER_1", "TIER_2")


def citations(selected: DataFrame) -> DataFrame:
    """Rows of a request numbered from 1 in their order."""
    return selected.withColumn("citation_id", F.row_number().over(W.partitionBy("request").orderBy("rank")))


def registry_ids(cited: DataFrame) -> DataFrame:
    """request, valid, binding, strong (TIER_1 to TIER_3): arrays of ids."""
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("citation_id"))))
    return cited.groupBy("request").agg(ids(F.lit(True)).alias("valid"), ids(binding_eaeu()).alias("binding"), ids(F.col("source_tier").isin("TIER_1", "TIER_2", "TIER_3")).alias("strong"))


def context(cited: DataFrame, most: int = 2600) -> DataFrame:
    """request, context: the numbered fragments in order, quoted text made harmless."""
    crumb = F.when(F.col("paragraph") != "", F.concat(F.lit("п. "), F.col("paragraph"))).otherwise("")
    label = lambda names, column, other: F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)], F.lit(other))
    n, mark = F.col("citation_id"), lambda word: F.concat(F.lit(f"<<<{FRAGMENT} "), F.col("citation_id"), F.lit(f" {word}>>>"))
    lines = F.concat_ws("\n", mark(BEGINS),
        F.concat(F.lit("["), n, F.lit("] "), T.citation_header(F.col("short_title"), F.col("title"), crumb, F.lit(""))),
        F.concat(F.lit(SOURCE), F.col("source_authority"), F.lit(" | "), label(TIER_LABELS, "source_tier", OTHER_TIER)),
        F.concat(F.lit(STATUS), label(STATUS_LABELS, "status", OTHER_STATUS), F.lit(" | "), label(VERSION_LABELS, "version_status", "")),
        F.lit(TEXT), T.neutral_delimiters(F.substring("text", 1, most)), mark(ENDS))
    blocks = cited.select("request", F.struct("citation_id", lines.alias("block")).alias("b"))
    return blocks.groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("context"))


def validated_ids(ids: Column, valid: Column) -> tuple[Column, Column]:
    """Ids that exist, in order and with repeats, and those that don't."""
    have = F.coalesce(valid, F.array().cast("array<int>"))
    given = F.coalesce(ids, F.array().cast("array<int>"))
    return F.filter(given, lambda i: F.array_contains(have, i)), F.filter(given, lambda i: ~F.array_contains(have, i))


def validated_statements(statements: DataFrame, ids: DataFrame) -> DataFrame:
    """statements(request, no, kind, text, citation_ids) after the rules: unknown ids go;
    a requirement without a citation, or with reference sources only, becomes an
    interpretation that says so."""
    s = statements.join(ids, "request", "left")
    kept, gone = validated_ids(F.col("citation_ids"), F.col("valid"))
    s = s.withColumns({"kept": kept, "invalid": gone})
    norm = F.col("kind") == "normative_requirement"
    uncited = norm & (F.size("kept") == 0)
    weak = norm & ~uncited & ~F.arrays_overlap("kept", F.coalesce("strong", F.array().cast("array<int>")))
    return s.select(
        "request", "no", F.when(uncited | weak, "regulatory_interpretation").otherwise(F.col("kind")).alias("kind"),
        F.when(uncited, F.concat(F.lit(UNCITED), F.col("text"))).when(weak, F.concat(F.lit(ONLY_REFERENCE), F.col("text"))).otherwise(F.col("text")).alias("text"),
        F.col("kept").alias("citation_ids"), F.col("invalid").alias("invalid_ids"), uncited.alias("uncited"),
    )


def validated_decisions(decisions: DataFrame, ids: DataFrame) -> DataFrame:
    """decisions(request, no, status, rationale, citation_ids): a firm one without a citation loses its status."""
    d = decisions.join(ids.select("request", "valid"), "request", "left")
    kept, gone = validated_ids(F.col("citation_ids"), F.col("valid"))
    bare = (F.size(kept) == 0) & F.col("status").isin("required", "not_required")
    rationale = F.when(bare, T.trimmed(F.concat(F.lit(NO_BASIS), F.coalesce("rationale", F.lit(""))))).otherwise(F.col("rationale"))
    return d.select("request", "no", F.when(bare, "no_legal_basis_found").otherwise(F.col("status")).alias("status"), rationale.alias("rationale"), kept.alias("citation_ids"), gone.alias("invalid_ids"))


def validated_studies(studies: DataFrame, ids: DataFrame) -> DataFrame:
    """studies(request, no, category, kind, necessity, citation_ids), ordered by category."""
    s = studies.join(ids.select("request", "valid"), "request", "left")
    kept, gone = validated_ids(F.col("citation_ids"), F.col("valid"))
    bare = (F.size(kept) == 0) & (F.col("kind") == "normative_requirement")
    necessity = F.when(bare & (F.col("necessity") == "требуется"), "возможно требуется").otherwise(F.col("necessity"))
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    return s.select("request", "no", "category", place.cast("int").alias("category_no"), F.when(bare, "regulatory_interpretation").otherwise(F.col("kind")).alias("kind"), necessity.alias("necessity"), kept.alias("citation_ids"), gone.alias("invalid_ids"), bare.alias("uncited"))


def report(statements: DataFrame, cited: DataFrame, prose: DataFrame, known: DataFrame) -> DataFrame:
    """request -> invalid ids, unsupported act numbers, uncited count, ok, messages."""
    by = statements.groupBy("request").agg(F.array_sort(F.flatten(F.collect_list("invalid_ids"))).alias("invalid_ids"), F.count_if("uncited").alias("uncited"))
    said = prose.select("request", F.explode(T.act_numbers(F.col("text"))).alias("document_number"))
    said = said.join(known.select("document_number"), "document_number", "left_anti").join(cited.select("request", "document_number"), ["request", "document_number"], "left_anti")
    acts = said.groupBy("request").agg(F.array_sort(F.collect_set("document_number")).alias("unsupported"))
    r = by.join(acts, "request", "left").withColumn("unsupported", F.coalesce("unsupported", F.array().cast("array<string>")))
    listed = lambda c, a, b: F.array_join(F.transform(F.col(c), lambda i: F.concat(F.lit(a), i.cast("string"), F.lit(b))), ", ")
    messages = F.array_compact(F.array(
        F.when(F.size("invalid_ids") > 0, F.concat(F.lit(REMOVED), listed("invalid_ids", "[", "]"))),
        F.when(F.size("unsupported") > 0, F.concat(F.lit(ABSENT), listed("unsupported", "№ ", ""), F.lit(TO_CHECK))),
        F.when(F.col("uncited") > 0, F.concat(F.lit(BARE), F.col("uncited"), F.lit(MARKED))),
    ))
    ok = (F.size("invalid_ids") == 0) & (F.size("unsupported") == 0)
    return r.select("request", "invalid_ids", "unsupported", "uncited", ok.alias("ok"), messages.alias("messages"))


def limited(found: DataFrame, requests: DataFrame, cited: DataFrame, first: str) -> DataFrame:
    """A report with ``limitations``: the messages, after ``first`` where a request has no
    citation at all.  Every request of ``requests`` has a row."""
    ids = cited.groupBy("request").agg(F.count(F.lit(1)).alias("sources"))
    r = requests.select("request").join(found, "request", "left").join(ids, "request", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    said = F.coalesce("messages", none("string"))
    return r.select(
        "request", F.coalesce("invalid_ids", none("int")).alias("invalid_ids"), F.coalesce("unsupported", none("string")).alias("unsupported"), F.coalesce("uncited", F.lit(0)).alias("uncited"),
        F.coalesce("ok", F.lit(True)).alias("ok"), F.col("sources").isNotNull().alias("sufficient_basis"), F.when(F.col("sources").isNull(), F.concat(F.array(F.lit(first)), said)).otherwise(said).alias("limitations"),
    )


def validated_assessment(statements: DataFrame, studies: DataFrame, decisions: DataFrame, found: DataFrame, classes: DataFrame, cited: DataFrame, known: DataFrame) -> DataFrame:
    """The whole assessment of each request against its citations.

    statements(request, no, part, kind, text, citation_ids) of the parts strategy, risk and
    question; studies; decisions(request, no, name, status, rationale, citation_ids); conflicts
    ``found``(request, citation_ids); classes(request, text).  Act numbers are looked for in the
    class, in strategies and risks as validated, and in the rationales of the two first
    decisions, ``bioequivalence`` and ``biowaiver``.
    """
    ids = registry_ids(cited)
    s = validated_statements(statements, ids).join(statements.select("request", "no", "part"), ["request", "no"])
    d = validated_decisions(decisions, ids).join(decisions.select("request", "no", "name"), ["request", "no"])
    t = validated_studies(studies, ids)
    gone = found.join(ids.select("request", "valid"), "request", "left").select("request", validated_ids(F.col("citation_ids"), F.col("valid"))[1].alias("invalid_ids"), F.lit(False).alias("uncited"))
    every = s.select("request", "invalid_ids", "uncited").unionByName(t.select("request", "invalid_ids", "uncited")).unionByName(d.select("request", "invalid_ids", F.lit(False).alias("uncited"))).unionByName(gone)
    prose = classes.select("request", "text").unionByName(s.where("part <> 'question'").select("request", "text")).unionByName(d.where("name in ('bioequivalence', 'biowaiver')").select("request", F.col("rationale").alias("text")))
    return limited(report(every, cited, prose, known), classes, cited, EMPTY_ASSESSMENT)


def validated_answers(answers: DataFrame, statements: DataFrame, cited: DataFrame, known: DataFrame) -> DataFrame:
    """Chat answers(request, answer) with their statements: unknown references leave the
    answer and count as invalid; act numbers are looked for in what is left."""
    ids = registry_ids(cited)
    a = answers.join(ids.select("request", "valid"), "request", "left").withColumn("have", F.coalesce("valid", F.array().cast("array<int>")))
    kept = a.select("request", T.keep_known_references(F.col("answer"), F.col("have")).alias("answer"), F.filter(T.references(F.col("answer")), lambda i: ~F.array_contains("have", i)).alias("invalid_ids"))
    s = validated_statements(statements, ids).select("request", "invalid_ids", "uncited")
    every = s.unionByName(kept.select("request", "invalid_ids", F.lit(False).alias("uncited")))
    found = report(every, cited, kept.select("request", F.col("answer").alias("text")), known)
    return limited(found, answers, cited, EMPTY_ANSWER).join(kept.select("request", "answer"), "request")


def conflicts(cited: DataFrame) -> DataFrame:
    """request, kind, number, citation_ids: repealed beside valid acts, one number in
    several documents, binding beside foreign sources.  One pass: a request's few
    citations become an array, from which each kind is read."""
    row = F.struct("citation_id", "document_id", F.col("document_number").alias("number"), (F.col("status") == "superseded").alias("old"), binding_eaeu().alias("binding"), (F.col("source_authority") != "EAEU").alias("foreign"))
    by = cited.groupBy("request").agg(F.array_sort(F.collect_list(row)).alias("c"))
    ids = lambda test: F.transform(F.filter("c", test), lambda x: x["citation_id"])
    have = lambda test: F.exists("c", test)
    entry = lambda kind, number, found: F.struct(F.lit(kind).alias("kind"), number.alias("number"), found.alias("citation_ids"))
    several, none = F.size("c") >= 2, F.lit("")
    repealed = F.when(several & have(lambda x: x["old"]) & have(lambda x: ~x["old"]), entry("superseded", none, ids(lambda x: x["old"])))
    foreign = F.when(several & have(lambda x: x["binding"]) & have(lambda x: x["foreign"]), entry("supplementary", none, ids(lambda x: x["foreign"])))
    numbers = F.array_distinct(F.filter(F.transform("c", lambda x: x["number"]), lambda n: n != ""))
    of = lambda n: F.filter("c", lambda x: x["number"] == n)
    shared = F.filter(numbers, lambda n: F.size(F.array_distinct(F.transform(of(n), lambda x: x["document_id"]))) > 1)
    same = F.transform(shared, lambda n: entry("same_number", n, F.transform(of(n), lambda x: x["citation_id"])))
    found = F.concat(F.array_compact(F.array(repealed, foreign)), same)
    return by.select("request", F.explode(found).alias("f")).select("request", "f.kind", "f.number", "f.citation_ids")


def confidence(cited: DataFrame, used: DataFrame, found: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """request, level, score.  used(request, ids, total, cited, input_sufficient)."""
    w = weights
    c = cited.join(used, "request").withColumn("own", F.array_contains("ids", F.col("citation_id")))
    c = c.withColumn("counts", F.col("own") | ~F.max("own").over(W.partitionBy("request"))).where("counts")
    any_ = F.max("own")
    expert = (F.col("source_tier") == "TIER_3") & (F.col("source_authority") == "EAEU")
    g = c.groupBy("request", "total", "cited", "input_sufficient").agg(
        any_.alias("any_cited"), F.size(F.first("ids")).alias("n_ids"), F.count(F.lit(1)).alias("n"), F.count_if(binding_eaeu()).alias("binding"), F.countDistinct(F.when(binding_eaeu(), F.col("document_id"))).alias("acts"),
        F.count_if(expert).alias("experts"), F.max("score").alias("best"), F.count_if(F.col("version_status") != "requires_expert_validation").alias("confirmed"),
        F.count_if(F.col("source_tier") == "TIER_3").alias("third"), F.count_if(F.col("status") == "superseded").alias("old"),
    )
    g = g.join(found.groupBy("request").agg(F.count(F.lit(1)).alias("conflicts")), "request", "left")
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    raw = (
        F.lit(w["any"])
        + F.when(F.col("binding") > 0, w["binding"] + part(F.col("acts") > 1, w["several"])).when(F.col("experts") > 0, w["binding"]).otherwise(-w["supplementary"])
        + part(F.col("total") > 0, w["cited"] * F.col("cited") / F.col("total"))
        + w["strength"] * F.least(F.lit(1.0), F.greatest("best", F.lit(0.0)) * 25)
        + w["confirmed"] * F.col("confirmed") / F.col("n")
        + part(F.col("third") > 0, w["expert"])
        - part(F.col("old") > 0, w["superseded"])
        - part(F.coalesce("conflicts", F.lit(0)) > 0, w["conflict"])
        - part(~F.col("input_sufficient"), w["input"])
    )
    score = F.when(F.col("n_ids") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(raw, 9))))
    level = F.when(F.col("s") >= HIGH, "HIGH").when(F.col("s") >= MEDIUM, "MEDIUM").otherwise("LOW")
    scored = g.withColumn("s", score).select("request", level.alias("level"), F.bround("s", 3).alias("score"))
    return used.select("request").join(scored, "request", "left").select("request", F.coalesce("level", F.lit("LOW")).alias("level"), F.coalesce("score", F.lit(0.0)).alias("score"))


def version_note(cited: DataFrame) -> DataFrame:
    """request, unverified, total for requests with a source whose version isn't confirmed."""
    return cited.groupBy("request").agg(F.count_if(F.col("version_status") == "requires_expert_validation").alias("unverified"), F.count(F.lit(1)).alias("total")).where("unverified > 0")


def source_summary(cited: DataFrame) -> DataFrame:
    eaeu = F.col("source_authority") == "EAEU"
    return cited.groupBy("request").agg(F.count_if(binding_eaeu()).alias("binding"), F.count_if(eaeu & (F.col("source_tier") == "TIER_3")).alias("expert"), F.count_if(~eaeu).alias("foreign"))


def card_list(cards: DataFrame) -> DataFrame:
    """cards(request, rank, title, url, page_url) -> request, markdown: an item a card by rank, as a link to
    the file, else to the page, else the title alone.  A request has few cards (``ranking.split_cards``);
    one without any has no row, a null title is empty, equal ranks go by title."""
    link = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.nullif(F.col("page_url"), F.lit("")))
    title = F.coalesce("title", F.lit(""))
    item = F.when(link.isNotNull(), F.concat(F.lit("- ["), title, F.lit("]("), link, F.lit(")"))).otherwise(F.concat(F.lit("- "), title))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"])
    return cards.groupBy("request").agg(F.concat(F.lit(CARD_LIST), F.array_join(items, "\n")).alias("markdown"))


def shown_sources(cited: DataFrame, used: DataFrame, first: int = 5) -> DataFrame:
    """The citations used, or the first ones where none is."""
    c = cited.join(used.select("request", "ids"), "request", "left").withColumn("own", F.coalesce(F.array_contains("ids", F.col("citation_id")), F.lit(False)))
    any_ = F.max("own").over(W.partitionBy("request"))
    return c.where("true").withColumn("any_own", any_).where(F.col("own") | (~F.col("any_own") & (F.col("citation_id") <= first))).select("request", "citation_id", "document_id")


def all_ids(parts: list[Column]) -> Column:
    """Distinct citation ids of nested lists, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def fallback(requests: DataFrame, reason: str) -> DataFrame:
    """The fixed result of requests that get no answer: no basis, no model, out of scope."""
    said = {"no_basis": "Достаточное нормативное основание в доступной базе знаний не найдено.", "retrieval_only": "Показаны найденные фрагменты без сформированного ответа.", "out_of_scope": "Запрос вне регуляторной тематики."}
    return requests.select("request", F.lit(reason).alias("reason"), F.lit(said[reason]).alias("answer"), F.lit(False).alias("sufficient_basis"), F.lit("LOW").alias("level"), F.lit(0.0).alias("score"))
