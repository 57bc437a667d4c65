"""Text normalisation, tokens, identifiers and labels, as columns.

Regular expressions name their classes instead of ``\\w`` and ``\\s``: Java's
defaults are ASCII and would miss Cyrillic.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that stand for a space, that vanish, that are a minus.
SPACES = "      　      "
GONE = "­​‌‍﻿"
MINUS = "−‐‑"
QUOTES = "«»\"'“”„"
WORD, BLANK = r"[\p{L}\p{N}_]", r"[ \t\n\r\f\x0B]"
PAGE_LINE = rf"^{BLANK}*[-\x{{2014}}]?{BLANK}*[0-9]{{1,4}}{BLANK}*[-\x{{2014}}]?{BLANK}*$"

# Function words that carry no meaning in search.
STOP_WORDS = """
    и в во не что он на я с со как а то все она так его но да ты к у же вы за
    бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну
    вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там
    потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была
    сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому
    этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были
    куда зачем всех никогда можно при наконец два об другой хоть после над больше
    тот через эти нас про всего них какая много разве три эту моя впрочем хорошо
    свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно
    всю между также при этом является том числе
""".split()
STOP_WORDS = list(dict.fromkeys(STOP_WORDS))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else t)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def normalize_text(text: Column, compose: bool = False) -> Column:
    """Extraction artefacts out, meaning kept.  Null gives ''.  ``compose`` adds
    NFC, which costs a trip to Python; skip it for text known to be composed."""
    t = F.coalesce(text, F.lit(""))
    t = nfc(t) if compose else t
    t = F.translate(t, SPACES + MINUS + GONE, " " * len(SPACES) + "-" * len(MINUS))
    t = F.regexp_replace(t, rf"({WORD})-{BLANK}*\n{BLANK}*({WORD})", "$1$2")
    t = F.regexp_replace(t, r"\r\n|\r", "\n")
    t = F.array_join(F.filter(F.split(t, "\n"), lambda line: ~line.rlike(PAGE_LINE)), "\n")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, rf"{BLANK}+([,.;:!?%)\]])", "$1")
    t = F.regexp_replace(t, rf"([(\[]){BLANK}+", "$1")
    return trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def normalize_for_search(text: Column, compose: bool = False) -> Column:
    t = F.translate(F.lower(normalize_text(text, compose)), "ё", "е")
    t = F.regexp_replace(t, f"[{QUOTES}]", " ")
    return trimmed(F.regexp_replace(t, rf"{BLANK}+", " "))


#: A superset of the characters that ``normalize_text`` translates.
RARE = r"[\x{A0}\x{AD}\x{1680}-\x{3000}\x{FEFF}]"
_IN_LINE = r"[ \t\r\f\x0B]*+"
#: Texts that may hold a line of a page's number.
_PAGED = rf"(?:^|\n){_IN_LINE}[-\x{{2014}}]?{_IN_LINE}[0-9]{{1,4}}+{_IN_LINE}[-\x{{2014}}]?{_IN_LINE}(?:[\n\r\x{{85}}\x{{2028}}\x{{2029}}]|$)"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, for which ``value`` is computed once however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def changed_where(text: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` of texts that pass ``test``, others as they are."""
    return once(text, lambda x: F.when(test(x), change(x)).otherwise(x))


#: What a text must hold for any of the steps before its words to change it.
_ODD = rf"{RARE[:-1]}\r0-9]|-{BLANK}"


def _words_apart(t: Column) -> Column:
    """Rare spaces, hyphens at line ends, lines of page numbers and split numbers put right."""
    t = changed_where(t, lambda x: x.rlike(RARE), lambda x: F.translate(x, SPACES + MINUS + GONE, " " * len(SPACES) + "-" * len(MINUS)))
    t = changed_where(t, lambda x: x.rlike(rf"-{BLANK}*\n"), lambda x: F.regexp_replace(x, rf"({WORD})-{BLANK}*\n{BLANK}*({WORD})", "$1$2"))
    t = changed_where(t, lambda x: F.contains(x, F.lit("\r")), lambda x: F.regexp_replace(x, r"\r\n|\r", "\n"))
    t = changed_where(t, lambda x: x.rlike(_PAGED), lambda x: F.array_join(F.filter(F.split(x, "\n"), lambda line: ~line.rlike(PAGE_LINE)), "\n"))
    return changed_where(t, lambda x: x.rlike(rf"[0-9]{BLANK}++[.,][0-9]"), lambda x: F.regexp_replace(x, rf"(?<=[0-9]){BLANK}++([.,][0-9])", "$1"))


def tokens(text: Column, compose: bool = False, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words of one script or numbers, in order, repeats kept; stop words and
    single characters go.

    The tokens of ``normalize_for_search``, of whose steps only those are taken that can change
    a token, and these only on texts that have what they look for; one look tells most texts apart.
    """
    t = F.coalesce(text, F.lit(""))
    t = nfc(t) if compose else t
    t = changed_where(t, lambda x: x.rlike(_ODD), _words_apart)
    words = r"[а-яa-z]{2,}+|[0-9]{2,}+(?:[.,][0-9]++)?+|[0-9][.,][0-9]++"
    found = F.regexp_extract_all(F.replace(F.lower(t), F.lit("ё"), F.lit("е")), F.lit(words), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stop_words))


def chunk_id(document_id: Column, coordinates: list[Column], text: Column, ordinal: Column) -> Column:
    """``doc#coordinates#0007#hash`` of the case- and space-folded text."""
    slug = F.regexp_replace(F.concat_ws("|", *coordinates), "[^0-9A-Za-zА-Яа-яЁё]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    slug = F.when(slug == "", "root").otherwise(slug)
    plain = F.lower(trimmed(F.regexp_replace(text, rf"{BLANK}+", " ")))
    return F.concat_ws("#", document_id.cast("string"), slug, F.format_string("%04d", ordinal.cast("int")), F.substring(F.sha2(plain.cast("binary"), 256), 1, 12))


# Headings that name the issuing body and say nothing of the place.
LETTERHEAD = [
    "евразийская экономическая комиссия",
    "экспертный комитет по лекарственным средствам",
    "экспертный комитет по лекарственным средствам при коллегии",
    "рекомендация",
    "решение",
    "коллегия евразийской экономической комиссии",
    "совет евразийской экономической комиссии",
]
CARD_HEADING = "Карточка документа (текст не извлечён)"


def is_letterhead(value: Column) -> Column:
    return F.translate(F.lower(trimmed(value)), "ё", "е").isin(LETTERHEAD)


def breadcrumb(appendix, part, section, chapter, subsection, heading, paragraph, subparagraph) -> Column:
    """The place in a document, outermost first."""

    def some(value: Column, prefix: str = "") -> Column:
        return F.when(value != "", F.concat(F.lit(prefix), value))

    upper = F.array_compact(F.array(some(appendix, "Приложение "), some(part, "Часть "), some(section, "Раздел "), some(chapter, "Глава "), F.when(~is_letterhead(subsection), some(subsection))))
    own = F.when((heading != "") & ~is_letterhead(heading) & ~F.array_contains(upper, heading), heading)
    point = F.when(paragraph != "", F.concat(F.lit("п. "), paragraph, F.when(subparagraph != "", F.concat(F.lit(", подп. "), subparagraph)).otherwise("")))
    every = F.array_compact(F.concat(upper, F.array(own, point)))
    return F.array_join(F.filter(F.transform(every, trimmed), lambda x: x != ""), " · ")


def location_label(short_title: Column, title: Column, crumb: Column) -> Column:
    head = F.coalesce(F.nullif(short_title, F.lit("")), F.substring(title, 1, 80))
    return F.when(crumb != "", F.concat(head, F.lit(" · "), crumb)).otherwise(head)


def human_citation(short_title: Column, title: Column, adopted: Column) -> Column:
    head = F.coalesce(F.nullif(short_title, F.lit("")), F.substring(title, 1, 160))
    return F.when(adopted.isNotNull(), F.concat(head, F.lit(" от "), F.date_format(adopted, "dd.MM.yyyy"))).otherwise(head)


def pages_label(start: Column, end: Column) -> Column:
    one = F.concat(F.lit("с. "), start.cast("string"))
    both = (start > 0) & (end > 0) & (start != end)
    return F.when(both, F.concat(one, F.lit("–"), end.cast("string"))).when(start > 0, one).otherwise("")


def citation_header(short_title: Column, title: Column, crumb: Column, pages: Column) -> Column:
    head = F.coalesce(F.nullif(short_title, F.lit("")), F.substring(title, 1, 110))
    return F.array_join(F.filter(F.array(head, crumb, pages), lambda x: x != ""), " · ")


def snippet(text: Column, most: int = 700) -> Column:
    bare = F.regexp_replace(text, r"\A\[[^\]]{0,300}\]\n", "")
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.regexp_replace(F.substring(bare, 1, most), rf"{BLANK}+$", ""), F.lit("…")))


def neutral_delimiters(text: Column) -> Column:
    """Runs of three and more angle brackets become two."""
    return F.regexp_replace(F.regexp_replace(text, "<{3,}", "<<"), ">{3,}", ">>")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


ACT_NUMBER = rf"№{BLANK}*([0-9]{{1,4}})"


def significant_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[а-яёa-z0-9]{4,}"), F.lit(0)))


def matches_expected(expected: Column, title: Column, number: Column) -> Column:
    """An act number must be equal; otherwise half of the words are shared."""
    wanted = F.regexp_extract(expected, ACT_NUMBER, 1)
    words = significant_words(expected)
    shared = F.size(F.array_intersect(words, significant_words(title))) / F.size(words)
    return F.when(wanted != "", wanted == number).when(F.size(words) == 0, F.lit(False)).otherwise(shared >= 0.5)


def act_numbers(text: Column) -> Column:
    """Numbers of acts that a text mentions."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?iu)(?:решени|рекомендаци|распоряжени)[а-яё]*[ \t\n\r\f\x0B]+(?:совета|коллегии)?[^№.]{0,40}№[ \t\n\r\f\x0B]*([0-9]{1,4})"), F.lit(1))))


def references(text: Column) -> Column:
    """The ids of all ``[1, 7]`` in a text, in order and with repeats."""
    marks = F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,3}(?:\s*,\s*[0-9]{1,3})*)\]"), F.lit(1))
    return F.transform(F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*"))), lambda i: i.cast("int"))


#: A mark such as ``[1, 7]``; and a text in pieces: marks, what lies between, brackets that open none.
MARK = rf"\[[0-9]{{1,3}}(?:{BLANK}*,{BLANK}*[0-9]{{1,3}})*\]"
PIECES = rf"{MARK}|[^\[]+|\["


def keep_known_references(text: Column, known: Column) -> Column:
    """``[1, 7]`` keeps the ids in ``known`` (none, if null); an empty bracket goes. Null text gives an empty one."""
    ids = F.coalesce(known.cast("array<int>"), F.array().cast("array<int>"))

    def clean(piece: Column) -> Column:
        named = F.transform(F.regexp_extract_all(piece, F.lit("[0-9]+"), F.lit(0)), lambda i: i.cast("int"))
        kept = F.filter(named, lambda i: F.array_contains(ids, i))
        mark = F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(kept.cast("array<string>"), ", "), F.lit("]"))).otherwise("")
        return F.when(piece.rlike(f"^{MARK}$"), mark).otherwise(piece)

    return F.array_join(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0)), clean), "")


#: What ends a line, what is blank (also at a line's end), and lines that keep to themselves.
ENDS = r"[\n\x0B\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
EMPTY = r"[\p{Z}\t-\r\x1c-\x1f\x{85}]"
ITEM = rf"^(?:[-*+]{EMPTY}|\p{{Nd}}+[.)]{EMPTY}|#{{1,6}}{EMPTY}|>|\|)"


def prose_markdown(text: Column) -> Column:
    """Lines of prose join into paragraphs; lists, headings, quotes and tables keep their
    lines; blocks stand apart by one empty line.  Null text gives an empty one.

    Between two empty lines, prose goes on with whatever is above it; the first line that
    keeps to itself opens a block, if it isn't the first of all.
    """
    bare = lambda x: F.regexp_replace(x, f"^{EMPTY}+|{EMPTY}+$", "")
    whole = bare(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")))

    def block(run: Column) -> Column:
        lines = F.transform(F.split(run, ENDS), lambda x: F.struct(x.alias("line"), bare(x).rlike(ITEM).alias("kept")))
        first = F.array_position(F.transform(lines, lambda x: x["kept"]), True) - 1

        def piece(x: Column, i: Column) -> Column:
            before = F.when(i == 0, "").when(~x["kept"], " ").when(i == first, "\n\n").otherwise("\n")
            return F.concat(before, F.when(x["kept"], F.regexp_replace(x["line"], f"{EMPTY}+$", "")).otherwise(bare(x["line"])))

        return F.array_join(F.transform(lines, piece), "")

    return F.array_join(F.transform(F.split(whole, f"{ENDS}{EMPTY}*{ENDS}"), block), "\n\n")


def json_object(text: Column) -> Column:
    """The JSON object in a model's reply as VARIANT; null if there is none.
    A code fence goes, else everything outside the outermost braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = trimmed(F.when(fenced != "", fenced).otherwise(text))
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_extract(body, r"(?s)(\{.*\})", 1)))
