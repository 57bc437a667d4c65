"""Every query of the engine by name, with its SQL twin where there is one.

Names begin with the operator's number in the blueprint's inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import inn as N
from quillon.functions import text as T
from quillon.operators import embedding as E
from quillon.operators import evaluate as V
from quillon.operators import grounding as G
from quillon.operators import ingest as D
from quillon.operators import intake as I
from quillon.operators import ranking as R
from quillon.operators import registry as S
from quillon.plans import retrieval as P
from quillon.plans import sql as Q
from quillon.sources import tables as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = Q.with_(needs, sql) if needs else sql
        return f

    return keep


def joined(column: str, kind: str = "string") -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",")


# Sources and the registry.

REG = ["document_id", "title", "short_title", "document_number", "document_type", "source_tier", "source_authority", "status", "version_status", "language", "download_status", "sha256", "size_bytes"]


@query("s1_registry_scan", "reg", f"SELECT {', '.join(REG)} FROM reg")
def _(spark, sf):
    return B.registry(spark, sf).select(*REG)


@query("s2_chunk_scan", "chunk", "SELECT document_id, ordinal, sha256(text) AS text_hash, is_card, char_count, token_estimate FROM chunk")
def _(spark, sf):
    narrow = B.chunks(spark, sf).select("chunk_id", "document_id", "ordinal", F.sha2("text", 256).alias("text_hash"), "is_card", "char_count", "token_estimate")
    return narrow.orderBy("chunk_id").drop("chunk_id")


@query("s3_point_lookup", "reg", "SELECT document_id, title FROM reg WHERE document_id = 7")
def _(spark, sf):
    return S.by_id(B.registry(spark, sf), "document_id", 7).select("document_id", "title")


HASH = "(SELECT sha256 FROM reg GROUP BY sha256 HAVING count(*) > 1 ORDER BY sha256 LIMIT 1)"


@query("s4_hash_lookup", "reg", f"SELECT min(document_id) AS document_id FROM reg WHERE sha256 = {HASH}")
def _(spark, sf):
    d = B.registry(spark, sf).select("document_id", "sha256")
    twice = d.groupBy("sha256").count().where("count > 1").orderBy("sha256").limit(1).select("sha256")
    return d.join(F.broadcast(twice), "sha256").groupBy("sha256").agg(F.min("document_id").alias("document_id")).select("document_id")


@query("r1_equality_filters", "reg", "SELECT document_id FROM reg WHERE source_authority = 'EAEU' AND document_type = 'guideline'")
def _(spark, sf):
    return S.listed(B.registry(spark, sf), "EAEU", "guideline").select("document_id")


@query("r2_literal_search", "reg", "SELECT document_id FROM reg WHERE contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') OR contains(translate(short_title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') OR contains(document_number, 'the')")
def _(spark, sf):
    return S.listed(B.registry(spark, sf), search="THE").select("document_id")


@query("r3_registry_order", "reg", "SELECT document_id, row_number() OVER (ORDER BY source_tier NULLS FIRST, document_number NULLS FIRST, document_id) AS place FROM reg")
def _(spark, sf):
    from pyspark.sql import Window as W

    d = B.registry(spark, sf).select("document_id", "source_tier", "document_number")
    # places of numbers inside their tier, places of tiers (a row each), places of documents inside their number
    numbers = d.groupBy("source_tier", "document_number").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("source_tier").orderBy(F.asc_nulls_first("document_number"))) - F.col("n")
    tiers = numbers.groupBy("source_tier").agg(F.sum("n").alias("n"))
    tiers = tiers.select("source_tier", (F.sum("n").over(W.orderBy(F.asc_nulls_first("source_tier"))) - F.col("n")).alias("above"))
    starts = numbers.select("source_tier", "document_number", before.alias("before")).join(tiers, "source_tier")
    own = F.row_number().over(W.partitionBy("source_tier", "document_number").orderBy("document_id"))
    return d.join(starts, ["source_tier", "document_number"]).select("document_id", (F.col("above") + F.col("before") + own).alias("place"))


UPSERT = "SELECT document_id, status FROM reg WHERE document_id % 10 <> 3 UNION ALL SELECT document_id, 'second' FROM reg WHERE document_id % 10 = 3"


@query("r4_upsert", "reg", UPSERT)
def _(spark, sf):
    d = B.registry(spark, sf).select("document_id", "status")
    some = d.where("document_id % 10 = 3")
    batch = some.withColumns({"status": F.lit("first"), "seq": F.lit(1)}).unionByName(some.withColumns({"status": F.lit("second"), "seq": F.lit(2)}))
    return S.upserted(d, batch, "document_id", "seq")


@query("r5_replace_chunks", "chunk", "SELECT document_id, ordinal, sha256(text) AS text_hash FROM chunk WHERE document_id <> 5 UNION ALL SELECT 5, 0, sha256('one') UNION ALL SELECT 5, 1, sha256('two')")
def _(spark, sf):
    new = B.registry(spark, sf).where("document_id = 5").select("document_id", F.array(F.lit("one"), F.lit("two")).alias("text"))
    return S.replaced_chunks(B.chunks(spark, sf), 5, new).select("document_id", "ordinal", F.sha2("text", 256).alias("text_hash"))


@query("r6_chunk_counts", "chunk reg", "SELECT document_id, CASE WHEN document_id = 5 THEN 99 ELSE coalesce(m, 0) END::BIGINT AS n_chunks FROM reg LEFT JOIN (SELECT document_id, count(*) AS m FROM chunk GROUP BY ALL) USING (document_id)")
def _(spark, sf):
    return S.with_value(S.chunk_counts(B.registry(spark, sf), B.chunks(spark, sf)), "document_id", 5, "n_chunks", F.lit(99))


@query("r7_key_difference", "reg", "SELECT document_id FROM reg WHERE status <> 'active'")
def _(spark, sf):
    d = B.registry(spark, sf)
    return S.stale(d, d.where("status = 'active'"))


@query("r8_prune", "chunk reg", "SELECT document_id, count(*) AS n FROM chunk JOIN reg USING (document_id) WHERE reg.status = 'active' GROUP BY ALL")
def _(spark, sf):
    d = B.registry(spark, sf)
    docs, chunks = S.pruned(d, B.chunks(spark, sf), d.where("status = 'active'"))
    return chunks.join(docs.select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("r9_act_numbers", "reg", "SELECT DISTINCT document_number FROM reg WHERE document_number <> ''")
def _(spark, sf):
    return S.numbers(B.registry(spark, sf))


@query("r10_counts", "chunk reg", "SELECT (SELECT count(*) FROM reg) AS documents, (SELECT count(*) FROM chunk) AS chunks")
def _(spark, sf):
    return S.stats(B.registry(spark, sf), B.chunks(spark, sf)).select("documents", "chunks")


for _c in S.COUNTABLE:
    query(f"r11_counts_by_{_c}", "reg", f"SELECT coalesce(nullif({_c}, ''), 'unknown') AS value, count(*) AS n FROM reg GROUP BY ALL")(lambda spark, sf, c=_c: S.counts_by(B.registry(spark, sf), c))


@query("r12_counts_by_year", "reg", "SELECT coalesce(strftime(adoption_date, '%Y'), 'unknown') AS value, count(*) AS n FROM reg GROUP BY ALL")
def _(spark, sf):
    return S.counts_by_year(B.registry(spark, sf))


@query("r13_total_tokens", "chunk", "SELECT coalesce(sum(token_estimate), 0)::BIGINT AS tokens FROM chunk")
def _(spark, sf):
    return B.chunks(spark, sf).agg(F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"))


@query("r14_last_update", "reg", "SELECT max(downloaded)::BIGINT AS last_update FROM reg")
def _(spark, sf):
    return B.registry(spark, sf).agg(F.unix_timestamp(F.max("download_date")).alias("last_update"))


def _events(spark, sf):
    d = B.read(spark, sf, "events").select("user_id", "event_id", "event_type")
    return d.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("started"), (F.col("event_id") + 1).alias("finished"), F.when(F.col("event_id") % 2 == 0, "ok").otherwise("failed").alias("status"), F.col("event_id").alias("seq"))


RUNS = "SELECT user_id AS run_id, arg_max(event_type, event_id) AS stage, CASE WHEN max(event_id) % 2 = 0 THEN 'ok' ELSE 'failed' END AS status, min(event_id) AS started, max(event_id) + 1 AS finished FROM events GROUP BY ALL"


@query("r15_run_log", "", RUNS)
def _(spark, sf):
    return S.run_log(_events(spark, sf))


@query("r15_last_run", "", f"SELECT * FROM ({RUNS}) ORDER BY run_id DESC LIMIT 1")
def _(spark, sf):
    return S.last_run(_events(spark, sf))


@query("r16_corpus_stats", "chunk reg", """SELECT documents, raw_bytes, last_update, chunks, tokens, CASE WHEN documents > 0 THEN round(chunks / documents, 2) ELSE 0 END AS chunks_per_document,
 CASE WHEN chunks > 0 THEN round(tokens / chunks, 1) ELSE 0 END AS tokens_per_chunk
 FROM (SELECT count(*) AS documents, coalesce(sum(size_bytes), 0)::BIGINT AS raw_bytes, max(downloaded)::BIGINT AS last_update FROM reg), (SELECT count(*) AS chunks, coalesce(sum(token_estimate), 0)::BIGINT AS tokens FROM chunk)""")
def _(spark, sf):
    return S.stats(B.registry(spark, sf), B.chunks(spark, sf)).withColumn("last_update", F.unix_timestamp("last_update"))


@query("r16_topics", "reg", "SELECT value, count(*) AS n FROM (SELECT lang AS value FROM reg UNION ALL SELECT source FROM reg) WHERE value IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return S.topics(B.registry(spark, sf))


@query("r17_overview", "reg", "SELECT document_id, substr(title, 1, 140) AS title, coalesce(strftime(adoption_date, '%d.%m.%Y'), '') AS adopted, source_tier, status FROM reg ORDER BY source_tier, document_number, document_id LIMIT 600")
def _(spark, sf):
    return S.overview(B.registry(spark, sf))


@query("r18_count_order", "reg", "SELECT status AS value, count(*) AS n FROM reg GROUP BY ALL ORDER BY n DESC, value")
def _(spark, sf):
    return S.counts_by(B.registry(spark, sf), "status").orderBy(F.desc("n"), "value")


@query("r19_row_round_trip", "reg", "SELECT document_id, title, CASE WHEN document_id % 7 = 0 THEN NULL ELSE adoption_date END::VARCHAR AS adoption_date, coalesce(lang, '') AS language FROM reg")
def _(spark, sf):
    """Rows to text and back, with a bad date for every seventh."""
    d = B.registry(spark, sf).select("document_id", "title", "adoption_date", "language")
    text = F.when(F.col("document_id") % 7 == 0, "2010-13-99").otherwise(F.date_format("adoption_date", "yyyy-MM-dd"))
    written = d.select(F.to_json(F.struct("document_id", "title", text.alias("adoption_date"), F.nullif("language", F.lit("")).alias("language"))).alias("payload"))
    back = written.select(F.from_json("payload", "document_id bigint, title string, adoption_date string, language string").alias("r")).select("r.*")
    return back.select("document_id", F.coalesce("title", F.lit("")).alias("title"), F.try_to_date(F.substring("adoption_date", 1, 10), "yyyy-MM-dd").cast("string").alias("adoption_date"), F.coalesce("language", F.lit("")).alias("language"))


@query("r20_sidebar", "reg", "SELECT count(*) AS documents, count(*) FILTER (source_authority = 'EAEU') AS eaeu, count(*) FILTER (source_authority <> 'EAEU') AS other, count(*) FILTER (source_authority = 'EAEU' AND source_tier IN ('TIER_1', 'TIER_2')) AS binding, count(*) FILTER (status = 'superseded') AS superseded FROM reg")
def _(spark, sf):
    return S.sidebar(B.registry(spark, sf))


@query("r21_health", "chunk reg", """
SELECT c AS "check", CASE WHEN c = 'documents' THEN CASE WHEN found > 0 THEN 'OK' ELSE 'FAIL' END WHEN c IN ('bm25_entries', 'vectors') AND found = 0 THEN 'FAIL' WHEN found = expected THEN 'OK' ELSE 'WARN' END AS severity, found, expected FROM (
 SELECT 'documents' AS c, count(*) AS found, count(*) AS expected FROM reg UNION ALL SELECT 'manual', count(*) FILTER (download_status = 'manual_required'), 0 FROM reg UNION ALL SELECT 'failed', count(*) FILTER (download_status = 'failed'), 0 FROM reg
 UNION ALL SELECT 'without_chunks', count(*), 0 FROM reg WHERE download_status = 'ok' AND document_id NOT IN (SELECT document_id FROM chunk)
 UNION ALL SELECT 'bm25_entries', count(*), count(*) FROM chunk UNION ALL SELECT 'vectors', (SELECT count(*) FROM embeddings), count(*) FROM chunk)""")
def _(spark, sf):
    c = B.chunks(spark, sf)
    return S.health(B.registry(spark, sf), c, c, B.vectors(spark, sf))


# Text.


@query("t1_normalize", "", f"SELECT doc_id, sha256({Q.normal('text')}) AS h FROM documents")
def _(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text"), compose=True), 256).alias("h"))


@query("t2_normalize_search", "", f"SELECT doc_id, sha256({Q.searchable('text')}) AS h FROM documents")
def _(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", F.sha2(T.normalize_for_search(F.col("text")), 256).alias("h"))


@query("t3_tokens", "", f"SELECT doc_id, len(t)::INT AS n, sha256(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, {Q.tokens('text')} AS t FROM documents)")
def _(spark, sf):
    t = B.read(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("h"))


@query("t4_stop_words", "said", f"SELECT id, len(t)::INT AS n, sha256(array_to_string(t, ' ')) AS h FROM (SELECT id, {Q.tokens('text')} AS t FROM said)")
def _(spark, sf):
    """Messages in Russian, of which stop words go."""
    t = _said(spark, sf).select("id", T.tokens(F.col("text")).alias("t"))
    return t.select("id", F.size("t").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("h"))


@query("t5_chunk_ids", "chunk", f"SELECT document_id, ordinal, document_id || '#' || CASE WHEN paragraph = '' THEN 'root' ELSE paragraph END || '#' || printf('%04d', ordinal) || '#' || substr(sha256(lower({Q.trim(f'''regexp_replace(text, '{Q.BLANK}+', ' ', 'g')''')})), 1, 12) AS chunk_id FROM chunk")
def _(spark, sf):
    return B.chunks(spark, sf).select("document_id", "ordinal", "chunk_id")


_HEADS = {c: f"{Q.low(Q.trim(c))} IN ({', '.join(map(Q.q, T.LETTERHEAD))})" for c in ("subsection", "heading")}
_UPPER = "list_filter([" + ", ".join(f"CASE WHEN {c} <> '' THEN '{p}' || {c} END" for c, p in (("appendix", "Приложение "), ("part", "Часть "), ("section", "Раздел "), ("chapter", "Глава "))) + f", CASE WHEN subsection <> '' AND NOT {_HEADS['subsection']} THEN subsection END], lambda x: x IS NOT NULL)"
CRUMB = f"""SELECT document_id, line_no, array_to_string(list_filter(list_transform(list_concat(u, [CASE WHEN heading <> '' AND NOT {_HEADS['heading']} AND NOT list_contains(u, heading) THEN heading END,
 CASE WHEN paragraph <> '' THEN 'п. ' || paragraph || CASE WHEN subparagraph <> '' THEN ', подп. ' || subparagraph ELSE '' END END]), lambda x: {Q.trim('x')}), lambda x: x <> ''), ' · ') AS crumb
 FROM (SELECT *, {_UPPER} AS u FROM (SELECT *, CASE line_no % 4 WHEN 0 THEN subsection WHEN 1 THEN 'РЕШЕНИЕ' WHEN 2 THEN substr(line, 1, 40) ELSE '' END AS heading FROM lines))"""


@query("t6_breadcrumb", "lines", CRUMB)
def _(spark, sf):
    """The place of every line of an act; headings are a subsection, a letterhead, the line's beginning, or none."""
    n = F.col("line_no") % 4
    lines = D.structured(_acts(spark, sf)).withColumn("heading", F.when(n == 0, F.col("subsection")).when(n == 1, "РЕШЕНИЕ").when(n == 2, F.substring("line", 1, 40)).otherwise(""))
    names = ("appendix", "part", "section", "chapter", "subsection", "heading", "paragraph", "subparagraph")
    return lines.select("document_id", "line_no", T.breadcrumb(*[F.col(c) for c in names]).alias("crumb"))


@query("t7_labels", "reg", "SELECT document_id, coalesce(nullif(short_title, ''), substr(title, 1, 80)) || ' · п. 1' AS location, coalesce(nullif(short_title, ''), substr(title, 1, 160)) || coalesce(' от ' || strftime(adoption_date, '%d.%m.%Y'), '') AS cited FROM reg")
def _(spark, sf):
    short, title = F.col("short_title"), F.col("title")
    return B.registry(spark, sf).select("document_id", T.location_label(short, title, F.lit("п. 1")).alias("location"), T.human_citation(short, title, F.col("adoption_date")).alias("cited"))


@query("t8_metadata_cards", "chunk", "SELECT document_id FROM chunk WHERE is_card")
def _(spark, sf):
    return B.chunks(spark, sf).where(F.col("heading") == T.CARD_HEADING).select("document_id")


@query("t9_header_snippet", "reg chunk", "SELECT document_id, ordinal, coalesce(nullif(short_title, ''), substr(title, 1, 110)) || CASE WHEN paragraph <> '' THEN ' · п. ' || paragraph ELSE '' END || ' · с. 1–2' AS header, sha256(CASE WHEN length(text) <= 700 THEN text ELSE regexp_replace(substr(text, 1, 700), '[ \\t\\n\\r\\f\\x0B]+$', '') || '…' END) AS snippet FROM chunk")
def _(spark, sf):
    crumb = F.when(F.col("paragraph") != "", F.concat(F.lit("п. "), F.col("paragraph"))).otherwise("")
    prefixed = F.concat(F.lit("[path]\n"), F.col("text"))
    return B.chunks(spark, sf).select("document_id", "ordinal", T.citation_header(F.col("short_title"), F.col("title"), crumb, T.pages_label(F.lit(1), F.lit(2))).alias("header"), F.sha2(T.snippet(prefixed), 256).alias("snippet"))


@query("t10_binding", "reg", "SELECT document_id, source_authority = 'EAEU' AND source_tier IN ('TIER_1', 'TIER_2') AS binding FROM reg")
def _(spark, sf):
    return B.registry(spark, sf).select("document_id", G.binding_eaeu().alias("binding"))


@query("t11_delimiters", "", "SELECT page_id, sha256(regexp_replace(regexp_replace(replace(replace(html, '<', '<<<<'), '>', '>>>'), '<{3,}', '<<', 'g'), '>{3,}', '>>', 'g')) AS h FROM pages")
def _(spark, sf):
    many = F.replace(F.replace("html", F.lit("<"), F.lit("<<<<")), F.lit(">"), F.lit(">>>"))
    return B.read(spark, sf, "pages").select("page_id", F.sha2(T.neutral_delimiters(many), 256).alias("h"))


@query("t13_expected_match", "", "SELECT a.item_id AS a, b.item_id AS b FROM benchmark a JOIN benchmark b ON len(list_intersect(list_distinct(regexp_extract_all(lower(a.text), '[а-яёa-z0-9]{4,}')), list_distinct(regexp_extract_all(lower(b.text), '[а-яёa-z0-9]{4,}')))) >= 0.5 * len(list_distinct(regexp_extract_all(lower(a.text), '[а-яёa-z0-9]{4,}'))) AND len(regexp_extract_all(lower(a.text), '[а-яёa-z0-9]{4,}')) > 0")
def _(spark, sf):
    """Questions whose words are at least half in another's."""
    q = B.questions(spark, sf)
    return V.expected_matches(q.select(F.col("item_id").alias("a"), F.col("question").alias("x")), q.select(F.col("item_id").alias("b"), F.col("question").alias("y"), F.lit("").alias("number")))


@query("t14_to_latin", "named", f"SELECT document_id, {Q.to_latin('name')} AS latin FROM named")
def _(spark, sf):
    return _named(spark, sf).select("document_id", N.to_latin(F.col("name")).alias("latin"))


@query("t15_to_cyrillic", "", f"SELECT doc_id, sha256({Q.to_cyrillic('w')}) AS cyrillic FROM (SELECT doc_id, {Q.folded('text')} AS w FROM documents)")
def _(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", F.sha2(N.to_cyrillic(F.coalesce("text", F.lit(""))), 256).alias("cyrillic"))


def _named(spark, sf):
    """Every document with one name, and a title that quotes two."""
    names = list(N.ALIASES)
    first, second = B._pick(names, F.col("document_id") % len(names)), B._pick(names, (F.col("document_id") * 7 + 3) % len(names))
    quoted = F.concat(F.lit("О выборе «"), F.initcap(first), F.lit(" + "), second, F.lit("» и «лекарственного препарата», "), "title")
    return B.registry(spark, sf).select("document_id", first.alias("name"), quoted.alias("title"))


@query("t18_title_names", "named", f"SELECT document_id, {Q.from_title('title')} AS names FROM named")
def _(spark, sf):
    return _named(spark, sf).select("document_id", F.array_join(N.from_title(F.col("title")), ",").alias("names"))


def _said(spark, sf):
    """Every turn of a conversation behind a message of an applicant, in turn."""
    n = F.col("conv_id") + F.col("turn")
    text = F.concat(B._pick(Q.MESSAGES, n % len(Q.MESSAGES)), F.lit(" "), F.coalesce("text", F.lit("")))
    return B.read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.alias("text"))


@query("t19_detect_names", "said spelled", f"SELECT s.id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS names FROM said s LEFT JOIN spelled p ON contains({Q.folded('s.text')}, p.spelling) GROUP BY s.id")
def _(spark, sf):
    return N.detect(_said(spark, sf), "id", "text", N.vocabulary(spark)).select("id", F.array_join("inns", ",").alias("names"))


@query("t20_register_names", "named", f"SELECT DISTINCT inn FROM (SELECT unnest([{', '.join(Q.q(n) for n in N.ALIASES)}]) AS inn UNION ALL SELECT {Q.folded("'новое ' || name || ' ' || document_id % 50")} FROM named)")
def _(spark, sf):
    """A name for each document, many of them the same, added to the vocabulary."""
    new = _named(spark, sf).select(F.concat(F.lit("Новое "), "name", F.lit(" "), F.col("document_id") % 50).alias("inn"))
    return N.registered(N.vocabulary(spark), new)


@query("t21_fold", "said", f"SELECT id, sha256({Q.folded('text')}) AS folded, regexp_matches(text, '[А-Яа-яЁё]') AS cyrillic FROM said")
def _(spark, sf):
    return _said(spark, sf).select("id", F.sha2(N.folded(F.col("text")), 256).alias("folded"), N.is_cyrillic(F.col("text")).alias("cyrillic"))


#: RE2 knows word characters of ASCII only.
_STRENGTH = r"(?:^|[^\p{L}\p{N}_])(" + I.STRENGTH.removeprefix(r"(?iU)\b").replace(r"\w", r"[\p{L}\p{N}_]") + ")"


@query("t22_strength", "said", f"SELECT id, {Q.trim(f"regexp_extract(text, {Q.q(_STRENGTH)}, 1, 'i')")} AS strength FROM said")
def _(spark, sf):
    return _said(spark, sf).select("id", T.trimmed(F.regexp_extract("text", I.STRENGTH, 0)).alias("strength"))


@query("t24_escape_html", "", "SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS h FROM pages")
def _(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", F.sha2(T.escape_html(F.col("html")), 256).alias("h"))


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, {Q.q(f'^{T.EMPTY}+|{T.EMPTY}+$')}, '', 'g')"


_MARKED = f"'# Ответ' || {Q.LF} || coalesce(text, '') || {Q.LF} || '- раз' || {Q.LF} || 'и ещё ' || {Q.LF} || ' ' || {Q.LF} || '  1) два ' || {Q.LF} || coalesce(text, '') || {Q.LF} || '| a | b |' || {Q.LF} || {Q.LF} || coalesce(text, '') || {Q.LF} || 'конец' || {Q.LF} || '> цитата'"
PROSE = f"""SELECT conv_id, turn, sha256(string_agg(t, {Q.LF} || {Q.LF} ORDER BY r)) AS h FROM (
 SELECT conv_id, turn, r, array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 1 THEN '' WHEN NOT k[i] THEN ' ' WHEN i = list_position(k, true) THEN {Q.LF} || {Q.LF} ELSE {Q.LF} END || CASE WHEN k[i] THEN regexp_replace(x, {Q.q(f'{T.EMPTY}+$')}, '') ELSE {_stripped('x')} END), '') AS t FROM (
  SELECT conv_id, turn, r, l, list_transform(l, lambda x: regexp_matches({_stripped('x')}, {Q.q(T.ITEM)})) AS k FROM (
   SELECT conv_id, turn, generate_subscripts(b, 1) AS r, string_split_regex(unnest(b), {Q.q(T.ENDS)}) AS l FROM (
    SELECT conv_id, turn, string_split_regex({_stripped(_MARKED)}, {Q.q(f'{T.ENDS}{T.EMPTY}*{T.ENDS}')}) AS b FROM conversations)))) GROUP BY conv_id, turn"""


@query("t25_prose_markdown", "", PROSE)
def _(spark, sf):
    """Every turn between a heading, lists, a table and a quotation."""
    said = F.coalesce("text", F.lit(""))
    marked = F.concat(F.lit("# Ответ\n"), said, F.lit("\n- раз\nи ещё \n \n  1) два \n"), said, F.lit("\n| a | b |\n\n"), said, F.lit("\nконец\n> цитата"))
    return B.read(spark, sf, "conversations").select("conv_id", "turn", F.sha2(T.prose_markdown(marked), 256).alias("h"))


KNOWN = f"""SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(coalesce(text, '') || ' [1, 7] [9] [3]', {Q.q(T.PIECES)}), lambda p: CASE WHEN NOT regexp_full_match(p, {Q.q(T.MARK)}) THEN p
 ELSE coalesce('[' || nullif(array_to_string(list_filter(list_transform(regexp_extract_all(p, '[0-9]+'), lambda i: i::INT), lambda i: i IN (1, 3)), ', '), '') || ']', '') END), '') AS text FROM conversations"""


@query("t27_inline_references", "", KNOWN)
def _(spark, sf):
    d = B.read(spark, sf, "conversations")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" [1, 7] [9] [3]"))
    return d.select("conv_id", "turn", T.keep_known_references(said, F.array(F.lit(1), F.lit(3))).alias("text"))


@query("t29_act_numbers", "stm cit reg", "SELECT request, string_agg(DISTINCT n, ',' ORDER BY n) AS unsupported FROM (SELECT s.request, (s.request % 25)::VARCHAR AS n FROM stm s) x WHERE n NOT IN (SELECT document_number FROM reg) AND NOT EXISTS (SELECT 1 FROM cit c WHERE c.request = x.request AND c.document_number = n) GROUP BY request")
def _(spark, sf):
    r = _report(spark, sf).where("size(unsupported) > 0")
    return r.select("request", joined("unsupported").alias("unsupported"))


# Ranking.


def _index(spark, sf):
    return R.bm25_index(P.chunk_texts(spark, sf))


@query("k1_bm25_idf", "idf", "SELECT token, df, round(idf, 6) AS idf FROM idf")
def _(spark, sf):
    return _index(spark, sf)["idf"].select("token", "df", F.round("idf", 6).alias("idf"))


@query("k1_bm25_lengths", "words", "SELECT key, len(t)::INT AS dl FROM words")
def _(spark, sf):
    return _index(spark, sf)["lengths"]


@query("k2_bm25_search", "lex", "SELECT query, key, score, rank FROM lex")
def _(spark, sf):
    return R.bm25_search(_index(spark, sf), P.asked(spark, sf).select("query", "text"), 40)


@query("k3_dense_search", "den", "SELECT query, key, score, rank FROM den")
def _(spark, sf):
    return P.search(spark, sf, "vector").dense


DENSE_WHERE = "SELECT * FROM (SELECT q.vec_id AS query, p.vec_id AS key, round(list_inner_product(q.v, p.v), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, p.v), 6) DESC, p.vec_id)::INT AS rank FROM vec q, vec p WHERE q.vec_id % 100 = 0 AND p.vec_id IN (SELECT document_id FROM reg WHERE source_authority = 'EAEU')) WHERE rank <= 40"


@query("k4_dense_filter", "vec reg", DENSE_WHERE)
def _(spark, sf):
    v = B.vectors(spark, sf)
    p = v.join(B.registry(spark, sf).select("document_id", "source_authority"), "document_id").withColumnRenamed("document_id", "key")
    return R.dense_search(p, v.where("document_id % 100 = 0").withColumnRenamed("document_id", "query"), 40, F.col("source_authority") == "EAEU")


@query("k5_embed")
def _(spark, sf):
    return E.embed(B.read(spark, sf, "documents"), "doc_id", "text", "hashing", 64)


@query("k6_unit_vectors", "", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (3 * x::DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: 9 * y::DOUBLE * y::DOUBLE))), 1e-12))), 6) AS total FROM embeddings")
def _(spark, sf):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return B.read(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(R.unit(tripled), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("k8_vector_upsert", "", "SELECT vec_id AS key, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def _(spark, sf):
    v = B.read(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "label")
    return S.upserted(v, v.where("key % 5 = 0").withColumns({"label": F.lit(-1), "seq": F.lit(1)}), "key", "seq")


@query("k9_prune_vectors", "chunk", "SELECT count(*) FILTER (vec_id * 1000000 NOT IN (SELECT key FROM chunk)) AS removed, count(*) AS points FROM embeddings")
def _(spark, sf):
    p = P.points(spark, sf).select("key")
    gone = p.join(P.keyed_chunks(spark, sf).select("key"), "key", "left_anti").select("key", F.lit(1).alias("gone"))
    return p.join(gone, "key", "left").agg(F.count("gone").alias("removed"), F.count(F.lit(1)).alias("points"))


@query("k11_build_indexes", "words tf chunk vec", "SELECT (SELECT count(*) FROM chunk) AS chunks, (SELECT count(*) FROM words) AS bm25_entries, (SELECT count(*) FROM tf) AS postings, (SELECT count(DISTINCT token) FROM tf) AS terms, (SELECT count(*) FROM vec WHERE vec_id * 1000000 IN (SELECT key FROM chunk)) AS vectors")
def _(spark, sf):
    c = P.keyed_chunks(spark, sf)
    ix = R.bm25_index(c.select("key", "text"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("one", F.lit(1))
    row = n(c, "chunks").join(n(ix["lengths"], "bm25_entries"), "one").join(n(ix["postings"], "postings"), "one").join(n(ix["idf"], "terms"), "one")
    return row.join(n(R.pruned_points(P.points(spark, sf), c.select("key")), "vectors"), "one").drop("one")


RANKS = "query, key, vector_rank, vector_score, bm25_rank, bm25_score, score, rank"


@query("f1_rank_fusion", "one", f"SELECT {RANKS} FROM one")
def _(spark, sf):
    return P.search(spark, sf).first_level().select(*RANKS.split(", "))


@query("f2_hybrid_search", "one chunk", "SELECT o.query, o.rank, o.score, c.document_id, c.ordinal FROM one o JOIN chunk c USING (key)")
def _(spark, sf):
    s = P.search(spark, sf)
    return s.with_chunks(s.first_level(), "document_id", "ordinal").select("query", "rank", "score", "document_id", "ordinal")


@query("f3_bm25_only", "one_bm25", f"SELECT {RANKS} FROM one_bm25")
def _(spark, sf):
    return P.search(spark, sf, "bm25").first_level().select(*RANKS.split(", "))


@query("f3_vector_only", "one_vector", f"SELECT {RANKS} FROM one_vector")
def _(spark, sf):
    return P.search(spark, sf, "vector").first_level().select(*RANKS.split(", "))


TWO = "request, key, score, vector_rank, vector_score, bm25_rank, bm25_score, n_queries, rank"


@query("f4_multi_query_fusion", "two", f"SELECT {TWO} FROM two")
def _(spark, sf):
    return P.search(spark, sf).second_level().withColumn("n_queries", F.size("matched_queries").cast("long")).select(*TWO.split(", "))


@query("f6_methods", "two", "SELECT request, key, CASE WHEN vector_rank IS NULL THEN 'bm25' WHEN bm25_rank IS NULL THEN 'vector' ELSE 'vector,bm25' END AS methods FROM two")
def _(spark, sf):
    return P.search(spark, sf).second_level().select("request", "key", F.array_join(R.methods(), ",").alias("methods"))


@query("f7_readiness", "vec words", "SELECT (SELECT count(*) FROM vec) AS vectors, (SELECT count(*) FROM words) AS bm25_entries, (SELECT count(*) FROM vec) > 0 OR (SELECT count(*) FROM words) > 0 AS ready")
def _(spark, sf):
    v = P.points(spark, sf).agg(F.count(F.lit(1)).alias("vectors")).withColumn("one", F.lit(1))
    b = P.keyed_chunks(spark, sf).agg(F.count(F.lit(1)).alias("bm25_entries")).withColumn("one", F.lit(1))
    return v.join(b, "one").select("vectors", "bm25_entries", ((F.col("vectors") > 0) | (F.col("bm25_entries") > 0)).alias("ready"))


@query("f8_no_rerank", "keep", "SELECT request, key, score, rank FROM keep")
def _(spark, sf):
    return P.search(spark, sf, "hybrid").reranked().select("request", "key", "score", "rank")


@query("f9_lexical_rerank", "rr", "SELECT request, key, score, rank FROM rr")
def _(spark, sf):
    return P.search(spark, sf).reranked().select("request", "key", "score", "rank")


@query("f10_model_rerank")
def _(spark, sf):
    usable, _ = R.split_cards(P.search(spark, sf).candidates())
    return R.model_reranked(usable, _shared, 24).select("request", "key", "score", "rank")


def _shared(queries: list[str], texts: list[str]) -> list[float]:
    """A stand-in for a cross-encoder: share of the query's words."""
    return [len({*q.split()} & {*t.split()}) / max(1, len({*q.split()})) for q, t in zip(queries, texts, strict=True)]


@query("f11_cards", "cand", "SELECT request, document_id, row_number() OVER (PARTITION BY request ORDER BY rank)::INT AS rank FROM (SELECT * FROM cand WHERE is_card QUALIFY row_number() OVER (PARTITION BY request, document_id ORDER BY rank) = 1) QUALIFY row_number() OVER (PARTITION BY request ORDER BY rank) <= 5")
def _(spark, sf):
    return P.search(spark, sf).cards().select("request", "document_id", "rank")


@query("f12_tier_policy", "sel", "SELECT request, key, source_tier, rank FROM sel")
def _(spark, sf):
    return P.search(spark, sf).selected().select("request", "key", "source_tier", "rank")


CITED = "request, citation_id, document_id, ordinal, source_tier, score"


@query("f13_retrieve", "cit", f"SELECT {CITED} FROM cit")
def _(spark, sf):
    return P.search(spark, sf).cited().select(*CITED.split(", "))


@query("f14_binding_subset", "cit", "SELECT request, citation_id FROM cit WHERE bind")
def _(spark, sf):
    return P.search(spark, sf).cited().where(G.binding_eaeu()).select("request", "citation_id")


# Grounding.


def _statements(spark, sf):
    b = B.questions(spark, sf).select(F.col("item_id").alias("request"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("no"))
    n = F.col("request") + F.col("no")
    ids = F.when(n % 4 == 0, F.array().cast("array<int>")).otherwise(F.array((n % 14 + 1).cast("int"), ((F.col("request") * 3 + F.col("no")) % 20 + 1).cast("int")))
    text = F.concat(F.lit("S"), F.col("request"), F.lit("-"), F.col("no"), F.lit(" решение Совета № "), (F.col("request") % 25))
    return b.select("request", "no", B._pick(G.KINDS, n % 5).alias("kind"), text.alias("text"), ids.alias("citation_ids"))


def _cited(spark, sf):
    return P.search(spark, sf).cited()


def _settled(spark, sf):
    """The citations, a dozen a request at most, for plans that read them several times."""
    return P.settled(_cited(spark, sf))


def _valid(spark, sf, cited=None):
    return G.validated_statements(_statements(spark, sf), G.registry_ids(_cited(spark, sf) if cited is None else cited))


def _report(spark, sf):
    c = _settled(spark, sf)
    s = _statements(spark, sf)
    return G.report(G.validated_statements(s, G.registry_ids(c)), c, s.select("request", "text"), S.numbers(B.registry(spark, sf)))


@query("g1_citations", "cit", "SELECT request, citation_id, key FROM cit")
def _(spark, sf):
    return _cited(spark, sf).select("request", "citation_id", "key")


@query("g2_registry_ids", "ids", "SELECT request, array_to_string(valid, ',') AS valid, array_to_string(strong, ',') AS strong FROM ids")
def _(spark, sf):
    return G.registry_ids(_cited(spark, sf)).select("request", joined("valid").alias("valid"), joined("strong").alias("strong"))


@query("g3_citation_ids", "val0", "SELECT request, no, array_to_string(kept, ',') AS kept, array_to_string(invalid, ',') AS invalid FROM val0")
def _(spark, sf):
    return _valid(spark, sf).select("request", "no", joined("citation_ids").alias("kept"), joined("invalid_ids").alias("invalid"))


@query("g4_statements", "val1", f"SELECT request, no, CASE WHEN uncited OR weak THEN 'regulatory_interpretation' ELSE kind END AS kind, CASE WHEN uncited THEN {Q.q(G.UNCITED)} WHEN weak THEN {Q.q(G.ONLY_REFERENCE)} ELSE '' END || text AS text, uncited FROM val1")
def _(spark, sf):
    return _valid(spark, sf).select("request", "no", "kind", "text", "uncited")


DEC = f"SELECT request, no, {Q.pick(G.DECISIONS, '((request + no) % 5)')} AS status, text, kept FROM val0"


@query("g6_decisions", "val0", f"SELECT request, no, CASE WHEN len(kept) = 0 AND status IN ('required', 'not_required') THEN 'no_legal_basis_found' ELSE status END AS status, CASE WHEN len(kept) = 0 AND status IN ('required', 'not_required') THEN {Q.q(G.NO_BASIS)} ELSE '' END || text AS rationale FROM ({DEC})")
def _(spark, sf):
    s = _statements(spark, sf)
    d = s.select("request", "no", B._pick(G.DECISIONS, (F.col("request") + F.col("no")) % 5).alias("status"), F.col("text").alias("rationale"), "citation_ids")
    return G.validated_decisions(d, G.registry_ids(_cited(spark, sf))).select("request", "no", "status", "rationale")


STUDY = f"SELECT *, {Q.pick(G.CATEGORIES, '(no % 3)')} AS category FROM val0"


@query("g7_studies", "val0", f"SELECT request, no, category, ((no % 3) + 1)::INT AS category_no, CASE WHEN kind = 'normative_requirement' AND len(kept) = 0 THEN 'regulatory_interpretation' ELSE kind END AS kind, CASE WHEN kind = 'normative_requirement' AND len(kept) = 0 THEN 'возможно требуется' ELSE 'требуется' END AS necessity FROM ({STUDY})")
def _(spark, sf):
    s = _statements(spark, sf).withColumns({"category": B._pick(G.CATEGORIES, F.col("no") % 3), "necessity": F.lit("требуется")})
    return G.validated_studies(s, G.registry_ids(_cited(spark, sf))).select("request", "no", "category", "category_no", "kind", "necessity")


BAD = "(request % 25)::VARCHAR NOT IN (SELECT document_number FROM reg) AND NOT EXISTS (SELECT 1 FROM cit c WHERE c.request = v.request AND c.document_number = (v.request % 25)::VARCHAR)"


def _messages_sql(invalid: str, bad: str, uncited: str, first: str = "NULL") -> str:
    gone = f"CASE WHEN len({invalid}) > 0 THEN {Q.q(G.REMOVED)} || array_to_string(list_transform({invalid}, lambda i: '[' || i || ']'), ', ') END"
    acts = f"CASE WHEN {bad} THEN {Q.q(G.ABSENT)} || '№ ' || (request % 25) || {Q.q(G.TO_CHECK)} END"
    bare = f"CASE WHEN {uncited} > 0 THEN {Q.q(G.BARE)} || {uncited} || {Q.q(G.MARKED)} END"
    return f"array_to_string(list_filter([{first}, {gone}, {acts}, {bare}], lambda m: m IS NOT NULL), chr(10))"


def _limited_sql(invalid: str, uncited: str, first: str, more: str = "") -> str:
    """A report over val1 grouped by request; ``l`` holds the statements' unknown ids, ``u`` how many are uncited."""
    return f"""SELECT request, array_to_string(inv, ',') AS invalid, CASE WHEN bad THEN (request % 25)::VARCHAR ELSE '' END AS unsupported, unc AS uncited, len(inv) = 0 AND NOT bad AS ok, basis AS sufficient_basis,
{_messages_sql('inv', 'bad', 'unc', f"CASE WHEN NOT basis THEN {Q.q(first)} END")} AS limitations{more} FROM (SELECT v.*, list_sort({invalid}) AS inv, {uncited} AS unc, {BAD} AS bad, coalesce(len(i.valid), 0) > 0 AS basis, b.text AS question
FROM (SELECT request, flatten(list(invalid)) AS l, count(*) FILTER (uncited) AS u FROM val1 GROUP BY request) v JOIN benchmark b ON b.item_id = v.request LEFT JOIN ids i USING (request))"""


def _limited(df, *more):
    return df.select("request", joined("invalid_ids").alias("invalid"), joined("unsupported").alias("unsupported"), "uncited", "ok", "sufficient_basis", F.array_join("limitations", "\n").alias("limitations"), *more)


@query("g8_report", "val1 ids cit reg", _limited_sql("list_concat(list_concat(l, l), l)", "u * 2", G.EMPTY_ASSESSMENT))
def _(spark, sf):
    """Whole assessments: the statements as parts, as studies and, but for the last of each, as decisions; the last one's ids as a conflict's."""
    c, s = _settled(spark, sf), _statements(spark, sf)
    parts = s.withColumn("part", B._pick(["strategy", "risk", "question", "strategy"], F.col("no")))
    studies = s.withColumns({"category": B._pick(G.CATEGORIES, F.col("no") % 3), "necessity": F.lit("требуется")})
    decisions = s.where("no < 3").withColumns({"name": B._pick(["bioequivalence", "biowaiver", "additional_strengths"], F.col("no")), "status": B._pick(G.DECISIONS, (F.col("request") + F.col("no")) % 5), "rationale": F.col("text")})
    classes = B.questions(spark, sf).select(F.col("item_id").alias("request"), F.lit("Класс").alias("text"))
    r = G.validated_assessment(parts, studies, decisions, s.where("no = 3").select("request", "citation_ids"), classes, c, S.numbers(B.registry(spark, sf)))
    return _limited(r)


@query("g9_chat_answer", "val1 ids cit reg", _limited_sql("list_concat(l, CASE WHEN coalesce(len(i.valid), 0) > 0 THEN [40, 77] ELSE [1, 40, 77] END)", "u", G.EMPTY_ANSWER, ", question || ' решение Совета № ' || (request % 25) || CASE WHEN basis THEN ' [1] ' ELSE '  ' END AS answer"))
def _(spark, sf):
    c = _settled(spark, sf)
    said = B.questions(spark, sf).select(F.col("item_id").alias("request"), F.concat("question", F.lit(" решение Совета № "), F.col("item_id") % 25, F.lit(" [1, 40] [77]")).alias("answer"))
    return _limited(G.validated_answers(said, _statements(spark, sf), c, S.numbers(B.registry(spark, sf))), "answer")


@query("g10_messages", "val1 cit reg", f"SELECT request, len(inv) = 0 AND NOT bad AS ok, {_messages_sql('inv', 'bad', 'u')} AS messages FROM (SELECT *, {BAD} AS bad FROM (SELECT request, list_sort(flatten(list(invalid))) AS inv, count(*) FILTER (uncited) AS u FROM val1 GROUP BY request) v)")
def _(spark, sf):
    return _report(spark, sf).select("request", "ok", F.array_join("messages", "\n").alias("messages"))


CONFLICTS = """
SELECT request, 'superseded' AS kind, '' AS number, string_agg(citation_id::VARCHAR, ',' ORDER BY citation_id) FILTER (status = 'superseded') AS citation_ids FROM cit GROUP BY request HAVING count(*) >= 2 AND bool_or(status = 'superseded') AND bool_or(status <> 'superseded')
UNION ALL SELECT request, 'supplementary', '', string_agg(citation_id::VARCHAR, ',' ORDER BY citation_id) FILTER (source_authority <> 'EAEU') FROM cit GROUP BY request HAVING count(*) >= 2 AND bool_or(bind) AND bool_or(source_authority <> 'EAEU')
UNION ALL SELECT request, 'same_number', document_number, string_agg(citation_id::VARCHAR, ',' ORDER BY citation_id) FROM cit WHERE document_number <> '' GROUP BY request, document_number HAVING count(DISTINCT document_id) > 1"""


@query("g11_conflicts", "cit", CONFLICTS)
def _(spark, sf):
    return G.conflicts(_cited(spark, sf)).select("request", "kind", "number", joined("citation_ids").alias("citation_ids"))


USED = "SELECT request, list_sort(list_distinct(flatten(list(kept)))) AS ids, count(*) AS total, count(*) FILTER (len(kept) > 0) AS cited, request % 2 = 0 AS input_sufficient FROM val0 GROUP BY request"


def _used(spark, sf, cited=None):
    v = _valid(spark, sf, cited)
    return v.groupBy("request").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("citation_ids")))).alias("ids"), F.count(F.lit(1)).alias("total"), F.count_if(F.size("citation_ids") > 0).alias("cited")).withColumn("input_sufficient", F.col("request") % 2 == 0)


CONFIDENCE = f"""
SELECT request, CASE WHEN s >= 0.7 THEN 'HIGH' WHEN s >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level, round_even(s, 3) AS score FROM (
SELECT u.request, coalesce(CASE WHEN len(ids) = 0 THEN 0 ELSE greatest(0, least(1, round(0.2::DOUBLE + CASE WHEN binding > 0 THEN 0.25 + CASE WHEN acts > 1 THEN 0.1 ELSE 0 END WHEN experts > 0 THEN 0.25 ELSE -0.25 END + CASE WHEN total > 0 THEN 0.2::DOUBLE * cited / total ELSE 0 END
  + 0.1::DOUBLE * least(1, greatest(best, 0) * 25) + 0.1::DOUBLE * confirmed / n + CASE WHEN third > 0 THEN 0.05 ELSE 0 END - CASE WHEN old > 0 THEN 0.15 ELSE 0 END - CASE WHEN c.request IS NOT NULL THEN 0.15 ELSE 0 END - CASE WHEN NOT input_sufficient THEN 0.2 ELSE 0 END, 9))) END, 0)::DOUBLE AS s
FROM ({USED}) u LEFT JOIN (SELECT request, count(*) AS n, count(*) FILTER (bind) AS binding, count(DISTINCT document_id) FILTER (bind) AS acts, count(*) FILTER (source_tier = 'TIER_3' AND source_authority = 'EAEU') AS experts, max(score) AS best,
  count(*) FILTER (version_status <> 'requires_expert_validation') AS confirmed, count(*) FILTER (source_tier = 'TIER_3') AS third, count(*) FILTER (status = 'superseded') AS old
  FROM (SELECT cit.*, list_contains(ids, citation_id) AS own, bool_or(list_contains(ids, citation_id)) OVER (PARTITION BY request) AS any_own FROM cit JOIN ({USED}) USING (request)) WHERE own OR NOT any_own GROUP BY request) g USING (request)
LEFT JOIN (SELECT DISTINCT request FROM ({CONFLICTS})) c USING (request))"""


@query("g12_confidence", "cit val0", CONFIDENCE)
def _(spark, sf):
    c = _settled(spark, sf)
    return G.confidence(c, _used(spark, sf, c), G.conflicts(c))


@query("g13_version_note", "cit", "SELECT request, count(*) FILTER (version_status = 'requires_expert_validation') AS unverified, count(*) AS total FROM cit GROUP BY request HAVING count(*) FILTER (version_status = 'requires_expert_validation') > 0")
def _(spark, sf):
    return G.version_note(_cited(spark, sf))


@query("g14_all_ids", "val0", "SELECT request, array_to_string(list_sort(list_distinct(flatten(list(kept)))), ',') AS ids FROM val0 GROUP BY request")
def _(spark, sf):
    return _used(spark, sf).select("request", joined("ids").alias("ids"))


@query("g18_fallbacks", "", "SELECT item_id AS request, r AS reason, false AS sufficient_basis, 0.0::DOUBLE AS score FROM benchmark, (SELECT unnest(['no_basis', 'retrieval_only', 'out_of_scope']) AS r)")
def _(spark, sf):
    b = B.questions(spark, sf).withColumnRenamed("item_id", "request")
    return R.union([G.fallback(b, r) for r in ("no_basis", "retrieval_only", "out_of_scope")]).select("request", "reason", "sufficient_basis", "score")


@query("g19_source_summary", "cit", "SELECT request, count(*) FILTER (bind) AS binding, count(*) FILTER (source_authority = 'EAEU' AND source_tier = 'TIER_3') AS expert, count(*) FILTER (source_authority <> 'EAEU') AS foreign FROM cit GROUP BY request".replace("AS foreign", 'AS "foreign"'))
def _(spark, sf):
    return G.source_summary(_cited(spark, sf))


@query("g19_shown_sources", "cit val0", f"SELECT request, citation_id, document_id FROM (SELECT cit.*, coalesce(list_contains(ids, citation_id), false) AS own, bool_or(coalesce(list_contains(ids, citation_id), false)) OVER (PARTITION BY request) AS any_own FROM cit LEFT JOIN ({USED}) USING (request)) WHERE own OR (NOT any_own AND citation_id <= 5)")
def _(spark, sf):
    c = _settled(spark, sf)
    return G.shown_sources(c, _used(spark, sf, c))


def _label(names: dict[str, str], column: str, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {Q.q(k)} THEN {Q.q(v)}" for k, v in names.items()) + f" ELSE {Q.q(other)} END"


CONTEXT = f"""SELECT request, string_agg('<<<{G.FRAGMENT} ' || citation_id || ' {G.BEGINS}>>>' || chr(10) || '[' || citation_id || '] ' || coalesce(nullif(short_title, ''), substr(title, 1, 110)) || CASE WHEN paragraph <> '' THEN ' · п. ' || paragraph ELSE '' END || chr(10)
|| {Q.q(G.SOURCE)} || source_authority || ' | ' || {_label(G.TIER_LABELS, 'source_tier', G.OTHER_TIER)} || chr(10) || {Q.q(G.STATUS)} || {_label(G.STATUS_LABELS, 'status', G.OTHER_STATUS)} || ' | ' || {_label(G.VERSION_LABELS, 'version_status', '')} || chr(10)
|| {Q.q(G.TEXT)} || chr(10) || regexp_replace(regexp_replace(substr(text, 1, 2600), '<{{3,}}', '<<', 'g'), '>{{3,}}', '>>', 'g') || chr(10) || '<<<{G.FRAGMENT} ' || citation_id || ' {G.ENDS}>>>', chr(10) || chr(10) ORDER BY citation_id) AS context FROM cit GROUP BY request"""


@query("t12_context", "cit", CONTEXT)
def _(spark, sf):
    return G.context(_cited(spark, sf))


# Intake.


@query("c2_first_match", "said", f"SELECT id, {Q.case(I.FORMS, Q.low('text'), '')} AS form, {Q.case(I.ROUTES, Q.low('text'), '')} AS route, {Q.case(I.RELEASES, Q.low('text'), 'unknown')} AS release FROM said")
def _(spark, sf):
    low = F.translate(F.lower("text"), "ё", "е")
    first = lambda table, name, none: F.coalesce(F.nullif(I.first_match(low, table), F.lit("")), F.lit(none)).alias(name)
    return _said(spark, sf).select("id", first(I.FORMS, "form", ""), first(I.ROUTES, "route", ""), first(I.RELEASES, "release", "unknown"))


@query("f16_inn_queries", "named", "SELECT document_id, 3 AS n, 'рекомендация Экспертного комитета о выборе референтного лекарственного препарата с МНН «' || name || '»' AS last FROM named")
def _(spark, sf):
    r = _named(spark, sf).withColumn("q", I.inn_queries(F.col("name")))
    return r.select("document_id", F.size("q").alias("n"), F.element_at("q", -1).alias("last"))


# Evaluation.

EVAL = "SELECT b.item_id AS request, string_agg(s.rank::VARCHAR, ',' ORDER BY s.rank) FILTER (r.request IS NOT NULL) AS ranks, min(s.rank) FILTER (r.request IS NOT NULL) AS first_hit, count(s.key) AS retrieved FROM benchmark b LEFT JOIN {sel} s ON s.request = b.item_id LEFT JOIN rel r ON r.request = b.item_id AND r.document_id = s.document_id GROUP BY b.item_id"


def _outcomes(spark, sf, selected=None, relevant=None):
    b = B.questions(spark, sf).withColumnRenamed("item_id", "request")
    return V.outcomes(b, P.search(spark, sf).selected() if selected is None else selected, P.relevant(spark, sf) if relevant is None else relevant)


@query("e1_outcomes", "sel rel", f"SELECT request, coalesce(ranks, '') AS ranks, first_hit, nullif(retrieved, 0) AS retrieved FROM ({EVAL.format(sel='sel')})")
def _(spark, sf):
    return _outcomes(spark, sf).select("request", joined("ranks").alias("ranks"), "first_hit", "retrieved")


METRICS = "count(*) AS questions, round(avg(CASE WHEN first_hit <= 5 THEN 1.0 ELSE 0.0 END), 3) AS recall_at_5, round(avg(CASE WHEN first_hit <= 10 THEN 1.0 ELSE 0.0 END), 3) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / first_hit, 0)), 3) AS mrr, count(*) FILTER (first_hit IS NULL) AS no_hit"


@query("e2_metrics", "sel rel", f"SELECT {METRICS} FROM ({EVAL.format(sel='sel')})")
def _(spark, sf):
    return V.metrics(_outcomes(spark, sf))


@query("e2_tier_mix", "sel", "SELECT source_tier, count(*) AS n FROM sel GROUP BY ALL")
def _(spark, sf):
    return V.tier_mix(P.search(spark, sf).selected())


MODES = {"bm25": "sel_plain_bm25", "vector": "sel_plain_vector", "hybrid": "sel_plain", "hybrid-rerank": "sel"}


@query("e3_ablation", "sel sel_plain sel_plain_bm25 sel_plain_vector rel", " UNION ALL ".join(f"SELECT '{m}' AS mode, {METRICS} FROM ({EVAL.format(sel=s)})" for m, s in MODES.items()))
def _(spark, sf):
    modes, relevant = P.searches(spark, sf), P.settled(P.relevant(spark, sf))
    return R.union([V.metrics(_outcomes(spark, sf, modes[m].selected(), relevant).withColumn("mode", F.lit(m)), "mode") for m in MODES])


@query("e4_answer_metrics", "val0", f"SELECT count(*) AS answers, round(sum(cited) / sum(total), 3) AS coverage, round(sum(kept) / sum(given), 3) AS validity, round(count(*) FILTER (kept = 0) / count(*), 3) AS abstention FROM (SELECT request, count(*) AS total, count(*) FILTER (len(kept) > 0) AS cited, sum(len(citation_ids)) AS given, sum(len(kept)) AS kept FROM val0 GROUP BY request)")
def _(spark, sf):
    v = _valid(spark, sf).groupBy("request").agg(F.count(F.lit(1)).alias("statements"), F.count_if(F.size("citation_ids") > 0).alias("cited"), F.sum(F.size("citation_ids") + F.size("invalid_ids")).alias("ids"), F.sum(F.size("citation_ids")).alias("valid_ids"))
    return V.answer_metrics(v.withColumn("abstained", F.col("valid_ids") == 0))


@query("e6_report", "sel rel", f"SELECT o.request, first_hit, coalesce(ranks, '') AS ranks, coalesce(t.titles, '') AS titles FROM ({EVAL.format(sel='sel')}) o LEFT JOIN (SELECT request, string_agg(title, chr(10) ORDER BY rank) AS titles FROM sel WHERE rank <= 5 GROUP BY request) t USING (request)")
def _(spark, sf):
    return V.report(_outcomes(spark, sf)).select("request", "first_hit", joined("ranks").alias("ranks"), F.coalesce(F.array_join("titles", "\n"), F.lit("")).alias("titles"))


# Ingestion.



def _acts(spark, sf):
    """Every text of ``documents`` as an act: lines of structure stand before or around its own lines, by the line's number."""
    n = lambda j: (j + 1).cast("string")
    kinds = [
        lambda x, j: F.array(F.concat(F.lit("ПРИЛОЖЕНИЕ № "), n(j)), x), lambda x, j: F.array(F.lit("Часть II"), x), lambda x, j: F.array(F.lit("РАЗДЕЛ III"), F.concat(n(j), F.lit(". "), x)),
        lambda x, j: F.array(F.concat(F.lit("Глава "), n(j), F.lit(". Общие")), F.concat(n(j), F.lit(". "), x)), lambda x, j: F.array(F.lit("Общие положения"), F.concat(n(j), F.lit(". "), x)), lambda x, j: F.array(F.concat(F.lit("а) "), x)),
        lambda x, j: F.array(F.lit("Показатель\tНорма"), F.concat(n(j), F.lit(".\t"), x)), lambda x, j: F.array(F.lit("IV. Требования"), x), lambda x, j: F.array(F.lit("Прочие требования"), x),
    ]

    def lines(x, j):
        out, kind = None, F.pmod(F.col("doc_id") + j, F.lit(10))
        for k, make in enumerate(kinds):
            out = F.when(kind == k, make(x, j)) if out is None else out.when(kind == k, make(x, j))
        return out.otherwise(F.array(x))

    d = B.read(spark, sf, "documents").where("doc_id is not null")
    return d.select(F.col("doc_id").alias("document_id"), F.array_join(F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lines)), "\n").alias("text"))


@query("i1_structure", "lines", f"SELECT document_id, line_no, level, is_table, {', '.join(D.LEVELS)} FROM lines")
def _(spark, sf):
    return D.structured(_acts(spark, sf)).select("document_id", "line_no", "level", "is_table", *D.LEVELS)


@query("i2_merged_units", "units", "SELECT document_id, unit, is_table, sha256(text) AS h, heading_only FROM units")
def _(spark, sf):
    return D.merged(D.structured(_acts(spark, sf))).select("document_id", F.col("unit").cast("int").alias("unit"), "is_table", F.sha2("text", 256).alias("h"), "heading_only")


@query("i3_act_chunks")
def _(spark, sf):
    return D.act_chunks(_acts(spark, sf)).select("document_id", "ordinal", "subsection", "paragraph", "is_table", "body_chars", F.sha2("text", 256).alias("h"))


@query("i4_cards", "reg", "SELECT document_id, title FROM reg WHERE length(text) < 20")
def _(spark, sf):
    return B.chunks(spark, sf).where("is_card").select("document_id", F.col("text").alias("title"))


@query("i5_language_filter", "", "SELECT doc_id AS document_id, round(len(regexp_extract_all(coalesce(text, ''), '[А-Яа-яЁё]'))::DOUBLE / greatest(len(regexp_extract_all(coalesce(text, ''), '\\p{L}')), 1), 6) AS cyrillic, false AS indexed FROM documents")
def _(spark, sf):
    d = B.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    return D.language_filter(d).select("document_id", "cyrillic", "indexed")


@query("i6_changed", "reg", "SELECT document_id FROM reg WHERE document_id % 9 = 0")
def _(spark, sf):
    d = B.registry(spark, sf).select("document_id", "sha256")
    new = d.withColumn("sha256", F.when(F.col("document_id") % 9 == 0, F.lit("new")).otherwise(F.col("sha256")))
    return D.changed(d, new).select("document_id")


@query("i7_title_vocabulary", "named", f"SELECT DISTINCT inn FROM (SELECT unnest([{', '.join(Q.q(n) for n in N.ALIASES)}]) AS inn UNION ALL SELECT unnest(string_split({Q.from_title('title')}, ',')) FROM named) WHERE inn <> ''")
def _(spark, sf):
    """The vocabulary with the names that documents' titles quote."""
    return N.registered(N.vocabulary(spark), _named(spark, sf).select(F.explode(N.from_title(F.col("title"))).alias("inn")))


@query("i8_same_act", "reg", "SELECT min(document_id) AS document_id FROM reg GROUP BY document_type, document_number, adoption_date")
def _(spark, sf):
    return D.same_act(B.registry(spark, sf)).select("document_id")


@query("l4_history", "", "SELECT conv_id, string_agg(role || ': ' || substr(coalesce(text, ''), 1, 800), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id")
def _(spark, sf):
    """The last six turns of a conversation, each cut to 800 characters, for a prompt."""
    c = R.top(B.read(spark, sf, "conversations"), "conv_id", 6, F.desc("turn"), name="n")
    said = F.concat("role", F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 800))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]), "\n").alias("history"))


@query("l10_card_list", "reg", f"""SELECT document_id // 5 AS request, {Q.q(G.CARD_LIST)} || string_agg('- ' || CASE WHEN document_id % 3 = 2 THEN title ELSE '[' || title || '](https://example.org/' || CASE document_id % 3 WHEN 0 THEN 'file/' ELSE 'page/' END || document_id || ')' END, {Q.LF} ORDER BY document_id) AS markdown FROM reg GROUP BY 1""")
def _(spark, sf):
    """Five documents a request, with a link to a file, to a page, or none."""
    n = F.col("document_id")
    link = lambda kind, on: F.when(on, F.concat(F.lit(f"https://example.org/{kind}/"), n))
    d = B.registry(spark, sf).select(F.floor(n / 5).alias("request"), n.alias("rank"), "title", F.coalesce(link("file", n % 3 == 0), F.lit("")).alias("url"), link("page", n % 3 < 2).alias("page_url"))
    return G.card_list(d)


from quillon.plans import changes, files, profiles, replies  # noqa: E402, F401  their queries are registered too
