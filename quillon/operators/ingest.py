"""From texts to chunks: structure, packing, language, refresh."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import BLANK, trimmed

#: Heading levels from the outermost; a heading resets the levels below it.
LEVELS = ["appendix", "part", "section", "chapter", "subsection", "paragraph", "subparagraph"]
#: Levels that a rule tells from the line itself.
RULES = {
    "appendix": rf"(?iu)^приложение{BLANK}*(№?{BLANK}*[0-9]*)", "part": rf"(?iu)^часть{BLANK}+([IVXLC]+)\b", "section": rf"(?iu)^(?:раздел{BLANK}+)?([IVXLC]+)(?:\.|$)",
    "chapter": rf"(?iu)^глава{BLANK}+([0-9]+)", "paragraph": rf"^([0-9]{{1,3}})\.{BLANK}", "subparagraph": rf"^([а-яa-z]|[0-9]{{1,2}})\){BLANK}",
}
#: A line of cells; a heading without a number: how it begins and ends, its length; how a finished line ends.
CELLS, TITLE, TITLE_CHARS, FINISHED = r"\t|\|| {3,}", r"^\p{Lu}(?:.*[^.;:,!?…-])?$", 120, "[.;:!?…]$"


def structured(documents: DataFrame) -> DataFrame:
    """documents(document_id, text) -> one row a line with its coordinates and ``is_table``.

    A scan of each document's lines in order: a line that opens a level sets it
    and clears the deeper ones. A level's value holds from the last line that
    set it, if no line since opened a level above.

    Two neighbouring lines of cells make a table; its lines open no level. A line
    without a number is a subsection's heading by what stands around it: it reads
    like a title, the line before it is finished or is a heading, and the next
    line opens a paragraph. Null and empty texts, and empty lines, give no rows.
    """
    lines = documents.select("document_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", trimmed(F.col("raw"))).where("line <> ''")
    rule = None
    for i, name in enumerate(LEVELS):
        if name in RULES:
            hit = F.col("line").rlike(RULES[name])
            rule = F.when(hit, i) if rule is None else rule.when(hit, i)
    lines = lines.withColumns({"rule": rule, "cells": F.col("line").rlike(CELLS)})
    order = W.partitionBy("document_id").orderBy("line_no")
    sub, paragraph = LEVELS.index("subsection"), LEVELS.index("paragraph")
    around = {f"{at}_{c}": f(c).over(order) for at, f in (("last", F.lag), ("next", F.lead)) for c in ("line", "rule", "cells")}
    lines = lines.withColumns(around)
    table = F.col("cells") & (F.coalesce("last_cells", F.lit(False)) | F.coalesce("next_cells", F.lit(False)))
    title = F.col("rule").isNull() & ~F.col("cells") & (F.length("line") <= TITLE_CHARS) & F.col("line").rlike(TITLE)
    after = F.col("last_line").isNull() | F.col("last_line").rlike(FINISHED) | (F.coalesce("last_rule", F.lit(paragraph)) < sub)
    heads = title & after & (F.coalesce("next_rule", F.lit(-1)) == paragraph) & ~F.coalesce("next_cells", F.lit(False))
    lines = lines.withColumns({"is_table": table, "level": F.when(table, None).when(heads, sub).otherwise(F.col("rule"))})
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    coordinates = {}
    for i, name in enumerate(LEVELS):
        own = F.col("line") if i == sub else trimmed(F.regexp_extract("line", RULES[name], 1))
        opened, cleared = F.when(F.col("level") == i, own), F.when(F.col("level") < i, F.lit(""))
        coordinates[name] = F.coalesce(F.last(F.coalesce(opened, cleared), ignorenulls=True).over(upto), F.lit(""))
    return lines.withColumns(coordinates).select("document_id", "line_no", "line", "level", "is_table", *LEVELS)


def merged(lines: DataFrame) -> DataFrame:
    """Units: an opening line with the lines that continue it, or a table, one text each."""
    order = W.partitionBy("document_id").orderBy("line_no")
    opens = F.col("level").isNotNull() | (F.col("is_table") != F.coalesce(F.lag("is_table").over(order), F.lit(False)))
    unit = lines.withColumn("opens", opens.cast("int")).withColumn("unit", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    heading = F.count_if(F.col("level") < LEVELS.index("paragraph"))
    by = unit.groupBy("document_id", "unit", "is_table", *LEVELS).agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"), heading.alias("headings"), F.count(F.lit(1)).alias("lines"))
    own = F.transform("l", lambda x: x["line"])
    text = F.when(F.col("is_table"), F.array_join(own, "\n")).otherwise(F.array_join(own, " "))
    return by.select("document_id", "unit", "is_table", *LEVELS, "line_no", text.alias("text"), (F.col("headings") == F.col("lines")).alias("heading_only"))


#: Where a text may be cut, and what a cut there costs: after a sentence or row, a clause, a word, anywhere.
SENTENCE, CLAUSE, BLANKS = re.compile(r"(?<=[.!?…])[ \t\n\r\f\x0B]+|\n+"), re.compile(r"(?<=[,;:])[ \t\n\r\f\x0B]+"), re.compile(r"[ \t\n\r\f\x0B]+")
COSTS = {"sentence": 0.0, "clause": 0.5, "word": 2.0, "letter": 8.0}
#: Short sentences, and words of an overlong clause, go together in runs of so many characters.
RUN = 80


def _spans(text: str, start: int, end: int, at: re.Pattern) -> list[tuple[int, int]]:
    out, s = [], start
    for m in at.finditer(text, start, end):
        if m.start() > s:
            out.append((s, m.start()))
        s = m.end()
    return [*out, (s, end)] if s < end else out


def atoms(text: str, most: int) -> list[tuple[int, int, str]]:
    """Pieces of at most ``most`` characters in order, each with what ends it: whole sentences, short ones together;
    of longer ones clauses; of longer ones runs of words; of longer words runs of letters."""
    out: list[tuple[int, int, str]] = []
    for s, e in _spans(text, 0, len(text), SENTENCE):
        if out and out[-1][2] == "sentence" and e - out[-1][0] <= min(RUN, most):
            out[-1] = out[-1][0], e, "sentence"
            continue
        if e - s <= most:
            out.append((s, e, "sentence"))
            continue
        for a, b in _spans(text, s, e, CLAUSE):
            if b - a <= most:
                out.append((a, b, "clause"))
                continue
            run = min(RUN, most)
            for c, d in _spans(text, a, b, BLANKS):
                if out and out[-1][2] == "word" and out[-1][0] >= a and d - out[-1][0] <= run:
                    out[-1] = out[-1][0], d, "word"
                    continue
                for x in range(c, d, most):
                    out.append((x, min(x + most, d), "letter" if x + most < d else "word"))
            out[-1] = (*out[-1][:2], "clause")
        out[-1] = (*out[-1][:2], "sentence")
    return out


def cheapest(sizes: Callable[[int, int], int], n: int, target: int, most: int, cut: Callable[[int], float]) -> list[int]:
    """Ends of the parts of ``n`` pieces, so that none is above ``most`` and the sum of the cuts' costs and
    the parts' distances from ``target`` is least. ``sizes(i, j)`` is the size of pieces i to j - 1, and grows with both
    ends; what is above ``most`` isn't looked at, so the time is linear in ``n`` for pieces that aren't tiny."""
    best, back = [0.0], [0]
    for j in range(1, n + 1):
        low, way = float("inf"), j - 1
        for i in range(j - 1, -1, -1):
            size = sizes(i, j)
            if size > most and i < j - 1:
                break
            cost = best[i] + abs(target - size) / target * (0.25 if j == n and size < target else 1.0) + (cut(i) if i else 0.0)
            if cost < low:
                low, way = cost, i
        best.append(low)
        back.append(way)
    ends, j = [], n
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


def cut_spans(text: str, target: int, most: int, overlap: int) -> list[tuple[int, int, int]]:
    """Parts of a text, none above ``most`` characters, each beginning with the sentence
    before it if that is whole and of at most ``overlap``: where a part begins, where its own text begins, where it ends.
    The own texts are the whole text, but for blanks at the cuts."""
    pieces = atoms(text, most)
    whole = [k == 0 or pieces[k - 1][2] == "sentence" for k in range(len(pieces))]  # begins a sentence

    def last(k: int) -> int:
        """Where the last sentence before piece k begins, if it is whole and short enough."""
        s, e, kind = pieces[k - 1]
        found = s if whole[k - 1] else e
        for m in SENTENCE.finditer(text, s, e):
            found = m.end()
        return found if kind == "sentence" and e - found <= overlap and found < e else pieces[k][0]

    before = [last(k) if k else s for k, (s, _, _) in enumerate(pieces)]

    def start(i: int, j: int) -> int:
        """Where the part of pieces i to j - 1 begins: with the overlap, unless there's no room for it."""
        return before[i] if pieces[j - 1][1] - before[i] <= most else pieces[i][0]

    ends = cheapest(lambda i, j: pieces[j - 1][1] - pieces[i][0], len(pieces), target, most, lambda i: COSTS[pieces[i - 1][2]])
    return [(start(i, j), pieces[i][0], pieces[j - 1][1]) for i, j in zip([0, *ends][:-1], ends, strict=True)]


def cut_text(text: str, target: int, most: int, overlap: int) -> list[str]:
    return [text[s:e] for s, _, e in cut_spans(text, target, most, overlap)]


def split_long(text: Column, target: int, most: int, overlap: int) -> Column:
    """Parts of a text of more than ``most`` characters, as ``cut_text`` has them; only such texts go to Python."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_text(t, target, most, overlap) for t in texts], index=texts.index, dtype=object)

    return F.coalesce(cut(F.when(F.length(text) > most, text)), F.array(text))


def packing(lengths: Column, apart: Column, target: int, most: int) -> Column:
    """Number of the pack of each piece, in order; no pack is above ``most``, and none goes across a piece that stands ``apart``."""

    def packs(sizes: list[int], alone: list[bool]) -> list[int]:
        out, number, s = [], 0, 0
        while s < len(sizes):
            e = s + 1
            while e < len(sizes) and not alone[e]:
                e += 1
            sums = [0, *itertools.accumulate(n + 1 for n in sizes[s:e])]
            ends = cheapest(lambda i, j, sums=sums: sums[j] - sums[i] - 1, e - s, target, most, lambda i: 0.0)
            for a, b in zip([0, *ends][:-1], ends, strict=True):
                out += [number] * (b - a)
                number += 1
            s = e
        return out

    @F.pandas_udf("array<int>")
    def number(sizes: pd.Series, alone: pd.Series) -> pd.Series:
        return pd.Series([packs(list(x), list(y)) for x, y in zip(sizes, alone, strict=True)], index=sizes.index, dtype=object)

    return number(lengths, apart)


def act_chunks(documents: DataFrame, target: int = 1600, most: int = 2600, overlap: int = 200) -> DataFrame:
    """Chunks of structured acts. Units of one appendix, part, section and chapter
    are packed towards ``target``; no body is above ``most``, none crosses those
    bounds, a table stands alone, headings without a text go, each chunk begins with its path."""
    units = merged(structured(documents)).where("not heading_only")
    units = units.select("*", F.posexplode(split_long(F.col("text"), target, most, overlap)).alias("part_no", "body"))
    outer = ["document_id", "appendix", "part", "section", "chapter"]
    # a place in the act may come again further down: what lies between bounds is told by its first unit
    order = W.partitionBy("document_id").orderBy("unit", "part_no")
    moved = F.lit(False)
    for c in outer[1:]:
        moved = moved | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    units = units.withColumn("bound", F.sum(moved.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    units = units.withColumn("apart", (F.col("part_no") > 0) | F.col("is_table") | F.coalesce(F.lag("is_table").over(order), F.lit(False)))
    places = units.groupBy(*outer, "bound").agg(F.array_sort(F.collect_list(F.struct("unit", "part_no", "body", "paragraph", "subsection", "is_table", "apart"))).alias("b"))
    number = packing(F.transform("b", lambda x: F.length(x["body"])), F.transform("b", lambda x: x["apart"]), target, most)
    each = places.withColumn("number", number).select(*outer, "bound", F.explode(F.arrays_zip("b", "number")).alias("z"))
    by = each.groupBy(*outer, "bound", F.col("z.number").alias("number")).agg(F.array_sort(F.collect_list("z.b")).alias("b"))
    first = F.element_at("b", 1)
    by = by.select("*", first["unit"].alias("unit"), first["paragraph"].alias("paragraph"), first["subsection"].alias("subsection"), first["is_table"].alias("is_table"), F.array_join(F.transform("b", lambda x: x["body"]), "\n").alias("body"))
    path = F.concat_ws(" · ", *[F.when(F.col(c) != "", F.concat(F.lit(f"{c} "), F.col(c))) for c in ("appendix", "part", "section", "chapter", "subsection", "paragraph")])
    ordinal = F.row_number().over(W.partitionBy("document_id").orderBy("bound", "number")) - 1
    return by.select("document_id", ordinal.alias("ordinal"), *outer[1:], "subsection", "paragraph", "is_table", F.length("body").alias("body_chars"), F.concat(F.lit("["), path, F.lit("]\n"), F.col("body")).alias("text"))


def language_filter(documents: DataFrame, cyrillic: float = 0.5, foreign: float = 0.2) -> DataFrame:
    """document_id, share of Cyrillic letters, share of other letters, indexed or not."""
    letters = F.greatest(F.regexp_count("text", F.lit(r"\p{L}")), F.lit(1))
    own = F.regexp_count("text", F.lit("[А-Яа-яЁё]")) / letters
    return documents.select("document_id", F.round(own, 6).alias("cyrillic"), F.round(1 - own, 6).alias("foreign"), ((own >= cyrillic) & (1 - own <= foreign)).alias("indexed"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose (document_id, sha256) isn't in ``old``: what a refresh must redo."""
    return new.join(old.select("document_id", "sha256"), ["document_id", "sha256"], "left_anti")


def same_act(documents: DataFrame) -> DataFrame:
    """The first document of each type, number and date."""
    w = W.partitionBy("document_type", "document_number", "adoption_date").orderBy("document_id")
    return documents.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
