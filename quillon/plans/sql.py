"""DuckDB twins: named common table expressions and what is built from them."""

from __future__ import annotations

from quillon.functions import inn as N
from quillon.functions import text as T
from quillon.operators import ingest as D
from quillon.operators import intake as I

BLANK = T.BLANK
LF = "chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def normal(x: str) -> str:
    t = f"nfc_normalize(coalesce({x}, ''))"
    t = f"translate({t}, {q(T.SPACES + T.MINUS + T.GONE)}, {q(' ' * len(T.SPACES) + '-' * len(T.MINUS))})"
    t = f"regexp_replace({t}, '({T.WORD})-{BLANK}*\\n{BLANK}*({T.WORD})', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '\\r\\n|\\r', {LF}, 'g')"
    t = f"array_to_string(list_filter(string_split({t}, {LF}), lambda l: NOT regexp_matches(l, '{T.PAGE_LINE}')), {LF})"
    t = f"regexp_replace({t}, '[ \\t]{{2,}}', ' ', 'g')"
    t = f"regexp_replace({t}, '{BLANK}+([,.;:!?%)\\]])', '\\1', 'g')"
    t = f"regexp_replace({t}, '([(\\[]){BLANK}+', '\\1', 'g')"
    return trim(f"regexp_replace({t}, '\\n{{3,}}', {LF} || {LF}, 'g')")


def searchable(x: str) -> str:
    t = f"translate(lower({normal(x)}), 'ё', 'е')"
    t = f"regexp_replace({t}, {q('[' + T.QUOTES + ']')}, ' ', 'g')"
    return trim(f"regexp_replace({t}, '{BLANK}+', ' ', 'g')")


def tokens(x: str) -> str:
    stop = ", ".join(q(w) for w in T.STOP_WORDS if len(w) > 1)
    return f"list_filter(regexp_extract_all({searchable(x)}, '[а-яa-z]+|[0-9]+(?:[.,][0-9]+)?'), lambda w: len(w) > 1 AND NOT list_contains([{stop}], w))"


def pick(values: list[str], index: str) -> str:
    return f"([{', '.join(q(v) for v in values)}])[{index} + 1]"


SETS: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, needs: tuple[str, ...], sql: str) -> None:
    SETS[name] = needs, sql


def with_(needs: str, sql: str) -> str:
    """``sql`` after the expressions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in SETS[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({SETS[n][1]})" for n in order) + "\n" + sql


define("reg", (), f"""
SELECT *, CASE WHEN n % 10 <= 2 THEN 'TIER_1' WHEN n % 10 <= 4 THEN 'TIER_2' WHEN n % 10 <= 7 THEN 'TIER_3' WHEN n % 10 = 8 THEN 'TIER_4' ELSE 'TIER_5' END AS source_tier,
       CASE WHEN n % 10 >= 8 THEN {pick(["ICH", "EMA", "WHO", "OTHER"], "n % 4")} ELSE 'EAEU' END AS source_authority,
       CASE WHEN document_id % 11 = 0 THEN '' ELSE n::VARCHAR END AS document_number,
       substr(split_part(text, {LF}, 1), 1, 160) || ' № ' || n AS title
FROM (SELECT d.doc_id AS document_id, coalesce(d.text, '') AS text, coalesce(d.lang, '') AS language, d.lang, d.source, coalesce(try_cast(substr(d.source, 4) AS INT), 0) AS n,
       CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE 'Act ' || d.doc_id END AS short_title,
       {pick(["council_decision", "college_decision", "expert_committee_recommendation", "guideline", "unknown"], "(d.doc_id % 5)")} AS document_type,
       CASE WHEN l.toxic = 1 THEN 'expired' WHEN l.quality = 0 THEN 'superseded' WHEN l.quality = 1 THEN 'active' ELSE 'unknown' END AS status,
       {pick(["consolidated", "original_with_known_amendments", "requires_expert_validation"], "(d.doc_id % 3)")} AS version_status,
       CASE WHEN d.doc_id % 13 <> 0 THEN DATE '2010-01-01' + (d.doc_id % 5000)::INT END AS adoption_date,
       1700000000 + d.doc_id AS downloaded,
       CASE WHEN d.doc_id % 17 = 0 THEN 'failed' WHEN d.doc_id % 17 = 1 THEN 'manual_required' ELSE 'ok' END AS download_status,
       sha256(coalesce(d.text, '')) AS sha256, strlen(coalesce(d.text, ''))::BIGINT AS size_bytes
      FROM documents d LEFT JOIN labels l USING (doc_id))""")
define("line", ("reg",), f"SELECT document_id, i, {trim('l')} AS l FROM (SELECT document_id, unnest(string_split(text, {LF})) AS l, generate_subscripts(string_split(text, {LF}), 1) AS i FROM reg WHERE length(text) >= 20)")
define("block", ("line",), "SELECT *, floor(coalesce(sum(length(l) + 1) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1600)::BIGINT AS b FROM line WHERE l <> ''")
define("body", ("block", "reg"), f"""
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY b) - 1 AS ordinal, t AS text, false AS is_card FROM (SELECT document_id, b, string_agg(l, {LF} ORDER BY i) AS t FROM block GROUP BY ALL)
UNION ALL SELECT document_id, 0, title, true FROM reg WHERE length(text) < 20""")
define("chunk", ("body", "reg"), """
SELECT b.document_id, b.ordinal::INT AS ordinal, b.document_id * 1000000 + b.ordinal AS key, b.text, b.is_card, CASE WHEN is_card THEN '' ELSE (b.ordinal + 1)::VARCHAR END AS paragraph,
       r.title, r.short_title, r.document_number, r.source_tier, r.source_authority, r.status, r.version_status, length(b.text)::INT AS char_count, greatest(1, length(b.text) // 3)::INT AS token_estimate
FROM body b JOIN reg r USING (document_id)""")
define("asked", (), """
SELECT item_id AS request, query_no, item_id * 10 + query_no AS query, CASE query_no WHEN 0 THEN text WHEN 1 THEN array_to_string(w[1:8], ' ') ELSE array_to_string(w[greatest(len(w) - 7, 1):], ' ') END AS text
FROM (SELECT item_id, text, regexp_split_to_array(trim(text), ' +') AS w FROM benchmark), (SELECT unnest([0, 1, 2]) AS query_no)""")
define("words", ("chunk",), f"SELECT key, {tokens('text')} AS t FROM chunk")
define("tot", ("words",), "SELECT count(*) AS n, avg(len(t)) AS avgdl FROM words")
define("tf", ("words",), "SELECT key, token, count(*) AS tf FROM (SELECT key, unnest(t) AS token FROM words) GROUP BY ALL")
define("raw", ("tf", "tot"), "SELECT token, count(*) AS df, round(ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5), 9) AS raw FROM tf, tot GROUP BY token")
define("idf", ("raw",), "SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT round(avg(raw), 9) FROM raw) ELSE raw END AS idf FROM raw")
define("qt", ("asked",), f"SELECT query, token, count(*) AS qtf FROM (SELECT query, unnest({tokens('text')}) AS token FROM asked) GROUP BY ALL")
define("lex0", ("qt", "idf", "tf", "words", "tot"), "SELECT query, key, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS score FROM qt JOIN idf USING (token) JOIN tf USING (token) JOIN words USING (key), tot GROUP BY ALL")
define("lex", ("lex0",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM lex0) WHERE rank <= 40 AND score > 0")
define("vec", (), "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12)) AS v FROM embeddings")
define("den0", ("vec", "asked", "chunk"), "SELECT a.query, c.key, round(list_inner_product(x.v, p.v), 6) AS score FROM asked a JOIN vec x ON x.vec_id = a.request AND a.query_no = 0, vec p JOIN chunk c ON c.key = p.vec_id * 1000000")
define("den", ("den0",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM den0) WHERE rank <= 40")


def first_level(lex: str = "lex", den: str = "den") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM (
  SELECT coalesce(d.query, l.query) AS query, coalesce(d.key, l.key) AS key, d.rank AS vector_rank, d.score AS vector_score, l.rank AS bm25_rank, l.score AS bm25_score,
         round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0), 9) AS score
  FROM {den} d FULL JOIN {lex} l ON d.query = l.query AND d.key = l.key)) WHERE rank <= 12"""


def second_level(one: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, key)::INT AS rank FROM (
  SELECT request, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(vector_rank) AS vector_rank, arg_min(vector_score, vector_rank * 10 + query_no) AS vector_score,
         min(bm25_rank) AS bm25_rank, arg_min(bm25_score, bm25_rank * 10 + query_no) AS bm25_score, count(DISTINCT text) AS n_queries
  FROM {one} JOIN asked USING (query) GROUP BY ALL)) WHERE rank <= 40"""


define("none", ("lex",), "SELECT * FROM lex WHERE false")
for mode, (lex, den) in {"hybrid": ("lex", "den"), "bm25": ("lex", "none"), "vector": ("none", "den")}.items():
    tail = "" if mode == "hybrid" else f"_{mode}"
    define(f"one{tail}", ("lex", "den", "none"), first_level(lex, den))
    define(f"two{tail}", (f"one{tail}", "asked"), second_level(f"one{tail}"))
    define(f"cand{tail}", (f"two{tail}", "chunk", "asked"), f"SELECT t.*, c.* EXCLUDE (key, text), c.text, a.text AS query_text FROM two{tail} t JOIN chunk c USING (key) JOIN asked a ON a.request = t.request AND a.query_no = 0")
    define(f"use{tail}", (f"cand{tail}",), f"SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY request ORDER BY rank)::INT AS rank FROM cand{tail} WHERE NOT is_card")
    define(f"keep{tail}", (f"use{tail}",), f"SELECT * FROM use{tail} WHERE rank <= 24")
define("rr0", ("use",), f"SELECT *, list_distinct({tokens('query_text')}) AS qd, list_distinct({tokens('text')}) AS dd FROM use")
define("rr1", ("rr0",), """SELECT * EXCLUDE (score), CASE WHEN len(qd) > 0 THEN round(0.6 * (len(list_intersect(qd, dd))::DOUBLE / len(qd) + CASE WHEN paragraph <> '' THEN 0.1 ELSE 0 END
  - CASE WHEN char_count < 200 THEN 0.05 ELSE 0 END) + 0.4 * tanh(50 * score), 9) ELSE score END AS score FROM rr0""")
define("rr", ("rr1",), "SELECT * EXCLUDE (rank), r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, rank) AS r FROM rr1) WHERE r <= 24")


def policy(of: str) -> str:
    return f"""SELECT * EXCLUDE (rank, tn, bn, ok, place, fk, lift, r2), r2::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY lift DESC, rank) AS r2 FROM (
  SELECT *, NOT bool_or(fk AND source_tier IN ('TIER_1', 'TIER_2')) OVER (PARTITION BY request) AND source_tier IN ('TIER_1', 'TIER_2') AND bn <= 2 AS lift FROM (
    SELECT *, ok AND place <= 12 AS fk FROM (SELECT *, sum(ok::INT) OVER (PARTITION BY request ORDER BY rank) AS place FROM (
      SELECT *, source_tier <> 'TIER_4' OR tn <= 3 AS ok FROM (SELECT *, row_number() OVER (PARTITION BY request, source_tier ORDER BY rank) AS tn,
        row_number() OVER (PARTITION BY request, source_tier IN ('TIER_1', 'TIER_2') ORDER BY rank) AS bn FROM {of})))) ) WHERE fk OR lift) WHERE r2 <= 12"""


define("sel", ("rr",), policy("rr"))
for mode in ("", "_bm25", "_vector"):
    define(f"sel_plain{mode}", (f"keep{mode}",), policy(f"keep{mode}"))
define("cit", ("sel",), "SELECT *, rank AS citation_id, source_authority = 'EAEU' AND source_tier IN ('TIER_1', 'TIER_2') AS bind FROM sel")
define("ids", ("cit",), "SELECT request, list_sort(list(citation_id)) AS valid, coalesce(list_sort(list(citation_id) FILTER (source_tier IN ('TIER_1', 'TIER_2', 'TIER_3'))), []) AS strong FROM cit GROUP BY request")
define("stm", (), f"""
SELECT item_id AS request, no, {pick(["normative_requirement", "regulatory_interpretation", "regulatory_risk", "potential_authority_question", "insufficient_basis"], "((item_id + no) % 5)")} AS kind,
       'S' || item_id || '-' || no || ' решение Совета № ' || (item_id % 25) AS text,
       CASE WHEN (item_id + no) % 4 = 0 THEN []::INT[] ELSE [(item_id + no) % 14 + 1, (item_id * 3 + no) % 20 + 1]::INT[] END AS citation_ids
FROM benchmark, (SELECT unnest([0, 1, 2, 3]) AS no)""")
define("val0", ("stm", "ids"), "SELECT s.*, list_filter(citation_ids, lambda i: list_contains(coalesce(valid, []), i)) AS kept, list_filter(citation_ids, lambda i: NOT list_contains(coalesce(valid, []), i)) AS invalid, coalesce(strong, []) AS strong FROM stm s LEFT JOIN ids USING (request)")
define("val1", ("val0",), "SELECT *, kind = 'normative_requirement' AND len(kept) = 0 AS uncited, kind = 'normative_requirement' AND len(kept) > 0 AND NOT list_has_any(kept, strong) AS weak FROM val0")
define("rel", (), "SELECT b.item_id AS request, d.doc_id AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")


def case(needles: list[tuple[str, str]], x: str, default: str, pattern: bool = False) -> str:
    hit = "regexp_matches({x}, {n})" if pattern else "contains({x}, {n})"
    return "CASE " + " ".join(f"WHEN {hit.format(x=x, n=q(n))} THEN {q(v)}" for n, v in needles) + f" ELSE {q(default)} END"


def low(x: str) -> str:
    return f"translate(lower({x}), 'ё', 'е')"


def folded(x: str) -> str:
    return f"translate({trim(f"regexp_replace(lower(coalesce({x}, '')), '{BLANK}+', ' ', 'g')")}, 'ё', 'е')"


def to_latin(x: str) -> str:
    letters = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in N.TO_LATIN.items()) + "}"
    return f"array_to_string(list_transform(regexp_extract_all({folded(x)}, '(?s:.)'), lambda c: coalesce({letters}[c], c)), '')"


def to_cyrillic(x: str) -> str:
    """Of a folded text."""
    cut = "CASE " + " ".join(f"WHEN {x} LIKE '%{e}' AND length({x}) > {len(e) + 4} THEN substr({x}, 1, length({x}) - {len(e)})" for e in N.SUFFIXES) + f" ELSE {x} END"
    letters = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in N.TO_CYRILLIC.items()) + "}"
    return f"array_to_string(list_transform(regexp_extract_all({cut}, '{'|'.join(N.TO_CYRILLIC)}|(?s:.)'), lambda c: coalesce({letters}[c], c)), '')"


def from_title(x: str) -> str:
    clean = f"list_transform(regexp_extract_all({x}, '«([^«»]{{3,80}})»', 1), lambda t: {folded("replace(t, '+', ' + ')")})"
    named = lambda y: " AND ".join(f"NOT contains({y}, {q(m)})" for m in N.NOT_A_NAME)
    clean = f"list_filter({clean}, lambda t: length(t) BETWEEN 4 AND 70 AND {named('t')})"
    parts = f"flatten(list_transform({clean}, lambda t: list_transform(string_split_regex(t, '{BLANK}*\\+{BLANK}*'), lambda p: regexp_replace(p, '^[ .,;:()\\[\\]]+|[ .,;:()\\[\\]]+$', '', 'g'))))"
    return f"array_to_string(list_sort(list_distinct(list_filter({parts}, lambda p: length(p) >= 4 AND {named('p')}))), ',')"


MESSAGES = [
    "МНН: ибупрофен\nЛекарственная форма: таблетки\nДозировка: 400 мг\nПуть введения: внутрь\nТип препарата: воспроизведённый\nВысвобождение: немедленное",
    "Нужна ли биоэквивалентность для таблеток амлодипина 5 мг, генерик?",
    "метформин",
    "Какую дозу мне принимать?",
    "Где найти решение № 85 о досье",
    "Гибридный препарат, капсулы с отсроченным высвобождением, 20 мг, перорально",
    "Высоковариабельный препарат в форме раствор для инъекций 10 мг/мл внутривенно",
    "биоаналог, раствор для инфузий, узкий терапевтический диапазон",
    "общие вопросы регистрации лекарственных средств",
    "",
    "дигоксин и варфарин: референтный препарат: не выбран",
    "Комбинированный препарат, мазь, наружно 5 г",
]
_NAMES = list(N.ALIASES)
define("said", (), f"SELECT conv_id * 1000 + turn AS id, {pick(MESSAGES, f'((conv_id + turn) % {len(MESSAGES)})')} || ' ' || coalesce(text, '') AS text FROM conversations")
define("named", ("reg",), f"""SELECT document_id, name, 'О выборе «' || upper(substr(name, 1, 1)) || CASE WHEN contains(name, ' ') THEN substr(name, 2, instr(name, ' ') - 1) || upper(substr(name, instr(name, ' ') + 1, 1)) || substr(name, instr(name, ' ') + 2) ELSE substr(name, 2) END
|| ' + ' || {pick(_NAMES, f'((document_id * 7 + 3) % {len(_NAMES)})')} || '» и «лекарственного препарата», ' || title AS title FROM (SELECT document_id, title, {pick(_NAMES, f'(document_id % {len(_NAMES)})')} AS name FROM reg)""")
define("alias", (), "SELECT * FROM (VALUES " + ", ".join(f"({q(n)}, {q(o)})" for n, others in N.ALIASES.items() for o in (n, *others)) + ") t(name, spelling)")
define("spelled", ("alias",), f"""SELECT DISTINCT name, spelling FROM (SELECT name, unnest(CASE WHEN length(s) > 7 AND NOT contains(s, ' ') THEN [s, substr(s, 1, length(s) - 2)] ELSE [s] END) AS spelling
FROM (SELECT name, spelling AS s FROM alias UNION SELECT name, {to_latin('name')} FROM alias)) WHERE length(spelling) >= 5""")


# Acts: the documents' texts with lines of structure, and what is read from them.

_KINDS = [
    "['ПРИЛОЖЕНИЕ № ' || j, x]", "['Часть II', x]", "['РАЗДЕЛ III', j || '. ' || x]", "['Глава ' || j || '. Общие', j || '. ' || x]", "['Общие положения', j || '. ' || x]", "['а) ' || x]",
    "['Показатель' || chr(9) || 'Норма', j || '.' || chr(9) || x]", "['IV. Требования', x]", "['Прочие требования', x]",
]
define("act", (), f"SELECT doc_id AS document_id, flatten(list_transform(string_split(coalesce(text, ''), {LF}), lambda x, j: CASE (doc_id + j - 1) % 10 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(_KINDS))} ELSE [x] END)) AS l FROM documents WHERE doc_id IS NOT NULL")
define("act_line", ("act",), f"SELECT document_id, line_no, line FROM (SELECT document_id, generate_subscripts(string_split(array_to_string(l, {LF}), {LF}), 1) - 1 AS line_no, {trim('unnest(string_split(array_to_string(l, ' + LF + '), ' + LF + '))')} AS line FROM act) WHERE line <> ''")
_RULES = {k: (v.removeprefix("(?iu)"), ", 'i'" if v.startswith("(?iu)") else "") for k, v in D.RULES.items()}
_SUB, _PAR = D.LEVELS.index("subsection"), D.LEVELS.index("paragraph")
define("ruled", ("act_line",), f"SELECT *, CASE {' '.join(f'WHEN regexp_matches(line, {q(_RULES[n][0])}{_RULES[n][1]}) THEN {i}' for i, n in enumerate(D.LEVELS) if n in _RULES)} END AS rule, regexp_matches(line, {q(D.CELLS)}) AS cells FROM act_line")
define("around", ("ruled",), "SELECT *, " + ", ".join(f"{f}({c}) OVER (PARTITION BY document_id ORDER BY line_no) AS {n}_{c}" for n, f in (("last", "lag"), ("next", "lead")) for c in ("line", "rule", "cells")) + " FROM ruled")
define("levels", ("around",), f"""SELECT document_id, line_no, line, is_table, CASE WHEN is_table THEN NULL WHEN rule IS NULL AND NOT cells AND length(line) <= {D.TITLE_CHARS} AND regexp_matches(line, {q(D.TITLE)})
 AND (last_line IS NULL OR regexp_matches(last_line, {q(D.FINISHED)}) OR coalesce(last_rule, {_PAR}) < {_SUB}) AND next_rule = {_PAR} AND NOT next_cells THEN {_SUB} ELSE rule END AS level
 FROM (SELECT *, cells AND (coalesce(last_cells, false) OR coalesce(next_cells, false)) AS is_table FROM around)""")


def _own(i: int, name: str) -> str:
    own = "line" if i == _SUB else trim(f"regexp_extract(line, {q(_RULES[name][0])}, 1{_RULES[name][1]})")
    return f"coalesce(last_value(CASE WHEN level = {i} THEN {own} WHEN level < {i} THEN '' END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS {name}"


define("lines", ("levels",), f"SELECT document_id, line_no::INT AS line_no, line, level, is_table, {', '.join(_own(i, n) for i, n in enumerate(D.LEVELS))} FROM levels")
define("units", ("lines",), f"""SELECT document_id, unit::INT AS unit, is_table, CASE WHEN is_table THEN string_agg(line, {LF} ORDER BY line_no) ELSE string_agg(line, ' ' ORDER BY line_no) END AS text, count(*) FILTER (level < {_PAR}) = count(*) AS heading_only FROM (
 SELECT *, sum(opens::INT) OVER (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS unit FROM (
  SELECT *, level IS NOT NULL OR is_table <> coalesce(lag(is_table) OVER (PARTITION BY document_id ORDER BY line_no), false) AS opens FROM lines)) GROUP BY document_id, unit, is_table""")
