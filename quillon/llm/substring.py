"""Substring deduplication by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of a document.  A word is removed if a
window that covers it has the same words as one that starts earlier (smaller
doc_id, or same document and earlier start).

Suffixes of all documents would go into a suffix tree, whose internal nodes of
depth ``WINDOW`` and more are the repeats.  The tree is never built in one
place: suffixes are split by prefixes of variable length into groups of at most
``GROUP`` suffixes, and each group's subtree is built alone, down to depth
``WINDOW``, below which nothing matters here.

1. Prefix counts.  A window's anchor is the first of its ``GRAM``-word pieces
   with the least code; equal windows have equal anchors at the same distance.
   One pass counts windows by the anchor's first word, two, four and eight words,
   in tables of fixed size.  A window's group is that of the shortest of these
   prefixes that no more than ``GROUP`` windows have; small prefixes share a group.
   Windows whose anchor is more frequent than that at every length are split by
   all of their words, so no prefix, however common, makes a large group.
2. Marks.  Only suffixes whose window repeats matter.  Anchors' pieces that two
   texts share, or one text has twice, mark the windows worth keeping; nothing
   that repeats is lost.
3. Subtrees.  Marked windows travel to their groups as stretches of a document's
   words, a stretch for each run of windows with one anchor.  There the suffixes
   from all windows' starts are sorted by their words and the lengths of the common
   prefixes of neighbours are taken; a run of neighbours with ``WINDOW`` words and
   more in common is what hangs below a deep node.  Every suffix of it but the
   earliest is removed.
4. Documents meet their removed windows and drop the words these cover.

Copies of a whole text are no work: all windows of a copy start earlier in the
copy with the smallest id, so only that one goes through 2 and 3.

Hot windows: each task sends a window (or mark) once for a stretch of
``STRETCH`` words, with its earliest place there; the other places in the stretch
are known to repeat (by two 64-bit codes) and go home by a key of their own, not
by the window's.  So a passage in a third of all documents meets as one row a
stretch.

Rows travel as packed binary, a group's rows of a stretch in one; words are
64-bit codes.  Null text: no words.  Null doc_id: after all others.  Rows with
one doc_id and one text are one document, at whose places windows are removed
alike; other texts of that doc_id are documents of their own, in the order of
their texts' hashes.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCodes, cut, documents, frugal, mix, shift_pair, words_of

WINDOW, GRAM = 20, 8
#: Suffixes a group, marks a bucket, words a stretch.
GROUP, BUCKET, STRETCH = 400_000, 1_500_000, 1_000_000
#: Lengths of prefixes, and bins of prefixes of each length.
DEPTHS, BINS = (1, 2, 4, 8), 1 << 14
ANCHOR = np.dtype([("code", "<u8"), ("text", "<u8")])
#: A window's start in a document, and a stretch of ``n`` windows from there.
PLACE = np.dtype([("doc", "<i8"), ("name", "<i8"), ("at", "<i4")])
HEAD = np.dtype([*PLACE.descr, ("n", "<u1")])


class Stretch:
    """Codes of some documents' words, end to end."""

    def __init__(self, codes: list[np.ndarray]):
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.words = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(codes)), self.sizes)

    def pieces(self, n: int) -> np.ndarray:
        """Code of the n words from each place (short at the end of the whole)."""
        out, code, width, at = None, self.words, 1, 0
        while True:  # n as a sum of powers of two, from pieces of doubled width
            if n & width:
                part = code[at:]
                out = part if out is None else shift_pair(out[: len(part)], part)
                at += width
            if width * 2 > n:
                return out
            code = shift_pair(code[: max(0, len(code) - width)], code[width:])
            width *= 2

    def whole(self, n: int) -> np.ndarray:
        """Places from which n words lie in one document."""
        left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(len(self.words))
        return np.flatnonzero(left >= n)

    def close(self, window: int, gram: int) -> np.ndarray:
        """Codes of the pieces that two places share of which every window between
        them holds one: at most ``window - gram + 1`` apart."""
        code = mix(self.pieces(gram))
        near = np.zeros(len(code), bool)
        for d in range(1, window - gram + 2):
            near[:-d] |= code[:-d] == code[d:]
        return np.unique(code[near])

    def anchors(self, window: int, gram: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the window at each of ``places`` has its first piece of the least code, and that code."""
        code, span, width = mix(self.pieces(gram)), window - gram + 1, 1
        at = np.arange(len(code))
        while width * 2 <= span:
            near, far = at[: len(at) - width], at[width:]
            at = np.where(code[far] < code[near], far, near)
            width *= 2
        near, far = at[places], at[places + span - width]
        at = np.where(code[far] < code[near], far, near)
        return at, code[at]

    def prefixes(self, at: np.ndarray) -> list[np.ndarray]:
        """The bin of the prefix of each length of the suffixes ``at``."""
        return [(mix(self.pieces(depth))[at] % np.uint64(BINS)).astype(np.int64) for depth in DEPTHS]


def stretches(batches, columns: tuple[str, ...], codes: WordCodes, most: int = STRETCH):
    """(rows, Stretch) for runs of rows of at most ``most`` words, or one row."""
    for pdf in batches:
        rows, parts, n = [], [], 0
        for row in pdf[list(columns)].itertuples(index=False):
            own = codes.of(words_of(row.text if isinstance(row.text, str) else None))
            if rows and n + len(own) > most:
                yield rows, Stretch(parts)
                rows, parts, n = [], [], 0
            rows.append(row)
            parts.append(own)
            n += len(own)
        if rows:
            yield rows, Stretch(parts)


# 1. Groups by prefixes of variable length.


def prefix_counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Windows by bin of the prefix of each length of their anchors."""

    def run(batches):
        codes, total = WordCodes(), np.zeros(len(DEPTHS) * BINS, np.int64)
        for _, s in stretches(batches, ("text",), codes):
            if len(where := s.whole(window)):
                for level, own in enumerate(s.prefixes(s.anchors(window, gram, where)[0])):
                    total += np.bincount(own + level * BINS, minlength=len(total))
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"bin": hit, "n": total[hit]})

    return docs.select("text").mapInPandas(frugal(run), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))


class Groups:
    """The group of a window by the shortest prefix that is rare enough."""

    def __init__(self, counts: np.ndarray, most: int = GROUP):
        counts = counts.reshape(len(DEPTHS), BINS)
        self.of_bin = np.full(counts.shape, -1, np.int64)
        group = held = 0
        for level, own in enumerate(counts.tolist()):
            for b, n in enumerate(own):
                if n > most:
                    continue
                if held + n > most:
                    group, held = group + 1, 0
                self.of_bin[level, b] = group
                held += n
        self.tail = group + 1
        self.parts = max(1, -(-int(counts[-1][counts[-1] > most].sum()) // most))

    def of(self, prefixes: list[np.ndarray], code: np.ndarray) -> np.ndarray:
        """For windows by their anchors' bins and the codes of all their words."""
        group = np.full(len(code), -1, np.int64)
        for table, own in zip(self.of_bin, prefixes, strict=True):
            group = np.where(group < 0, table[own], group)
        return np.where(group < 0, self.tail + (code % np.uint64(self.parts)).astype(np.int64), group)


# 2. Marks.


def packed(table: np.ndarray, key: np.ndarray, **fixed) -> pd.DataFrame:
    """The rows of a structured array by key, each key's rows as one binary."""
    order = np.argsort(key, kind="stable")
    key, table = key[order], table[order]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(key)][: len(cuts)]
    return pd.DataFrame({"key": key[cuts].astype(np.int64), "rows": pd.Series([table[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)], dtype=object)} | fixed)


def marks_of(docs: DataFrame, window: int, gram: int, buckets: int, homes: int) -> DataFrame:
    """name (code of a text), codes (binary): of each text the anchors' pieces that repeat."""

    def send(batches):
        codes = WordCodes()
        for rows, s in stretches(batches, ("text", "name"), codes):
            where = s.whole(window)
            if not len(where):
                continue
            names = np.array([r.name for r in rows], np.int64).view(np.uint64)
            least, doc = s.anchors(window, gram, where)[1], s.doc[where]
            new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]
            table = np.zeros(new.sum(), ANCHOR)
            table["code"], table["text"], doc = least[new], names[doc[new]], doc[new]
            first = np.unique(names, return_index=True)[1]  # a copied text once
            keep = np.isin(doc, first)
            table = table[keep]
            table.sort(order=["code", "text"])
            same = np.r_[False, table["code"][1:] == table["code"][:-1]]
            often = same | np.r_[same[1:], False] | np.isin(table["code"], s.close(window, gram))
            often = np.unique(table[often])
            yield packed(often, -1 - (often["text"] % np.uint64(homes)).astype(np.int64), known=True)
            yield packed(table[~same], table["code"][~same] % np.uint64(buckets), known=False)

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        if part.known.iloc[0]:
            return pd.DataFrame({"key": -1 - part.key[:1], "rows": [b"".join(part["rows"])]})
        table = np.concatenate([np.frombuffer(b, ANCHOR) for b in part["rows"]])
        table = table[np.argsort(table["code"], kind="stable")]
        code, text = table["code"], table["text"]
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        size = np.diff(np.r_[start, len(code)])
        other = np.repeat(text[start], size) != text
        table = table[np.repeat(np.add.reduceat(other, start) > 0, size)]
        return packed(table, table["text"] % np.uint64(homes))

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        return by_owner(np.unique(np.frombuffer(b"".join(part["rows"]), ANCHOR)), ["text"], "code", "codes")

    sent = docs.where("text is not null").select("text", F.xxhash64("text").alias("name")).mapInPandas(frugal(send), "key long, rows binary, known boolean")
    return sent.groupBy("key").applyInPandas(meet, "key long, rows binary").groupBy("key").applyInPandas(gather, "text long, codes binary").withColumnRenamed("text", "name")


def by_owner(table: np.ndarray, owner: list[str], what: str, named: str) -> pd.DataFrame:
    """One row for each ``owner`` of the table's rows with its ``what`` as one binary."""
    table = table[np.lexsort([table[c] for c in (what, *owner)])]
    own = table[owner]
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(own)][: len(cuts)]
    values = np.ascontiguousarray(table[what])
    return pd.DataFrame({c: np.ascontiguousarray(own[c][cuts]).view(np.int64) for c in owner} | {named: pd.Series([values[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)], dtype=object)})


# 3. Subtrees.


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, end to end."""
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)


def suffixes(marked: DataFrame, window: int, gram: int, groups: Groups, homes: int) -> DataFrame:
    """Packed rows by group: known False, runs of windows (the earliest of each window of a
    stretch) with their words; known True, places that are not the earliest, by a key of the document."""

    def send(batches):
        codes = WordCodes()
        for rows, s in stretches(batches, ("doc", "name", "text", "codes"), codes):
            where = s.whole(window)
            if not len(where):
                continue
            (anchor, least), doc = s.anchors(window, gram, where), s.doc[where]
            keep = np.zeros(len(where), bool)
            edge = np.searchsorted(doc, np.arange(len(rows) + 1))
            for k, row in enumerate(rows):
                own = np.frombuffer(b"".join(row.codes), np.uint64)
                keep[edge[k] : edge[k + 1]] = np.isin(least[edge[k] : edge[k + 1]], own)
            where, doc, anchor = where[keep], doc[keep], anchor[keep]
            if not len(where):
                continue
            code = s.pieces(window)[where]
            check = shift_pair(s.pieces(window - 3)[where + 3], s.words[where] ^ mix(s.words[where + 1] + s.words[where + 2]))
            place = np.zeros(len(where), PLACE)
            for c in ("doc", "name"):
                place[c] = np.array([getattr(r, c) for r in rows], np.int64)[doc]
            place["at"] = where - s.starts[doc]
            order = np.lexsort((place["at"], place["name"], place["doc"], check, code))
            same = np.r_[False, (code[order][1:] == code[order][:-1]) & (check[order][1:] == check[order][:-1])]
            again = np.r_[False, place[order][1:] == place[order][:-1]]  # a row and its repetition are one document
            late = order[same & ~again]
            first = np.sort(order[~same])
            where, anchor, code = where[first], anchor[first], code[first]
            group = groups.of(s.prefixes(anchor), code)
            # runs of windows of one anchor and one group, side by side in a document
            new = np.flatnonzero(np.r_[True, (np.diff(where) != 1) | (np.diff(anchor) != 0) | (np.diff(group) != 0)])
            head = np.zeros(len(new), HEAD)
            for c in PLACE.names:
                head[c] = place[c][first[new]]
            head["n"] = np.diff(np.r_[new, len(where)])
            yield packed_runs(s, head, where[new], group[new], window)
            if len(late):
                home = packed(place[late], -1 - homes_of(place[late], homes), known=True)
                yield home.rename(columns={"rows": "heads"}).assign(words=b"")

    return marked.mapInPandas(frugal(send), "key long, heads binary, words binary, known boolean")


def homes_of(place: np.ndarray, homes: int) -> np.ndarray:
    return (mix(place["doc"].astype(np.uint64) ^ place["name"].astype(np.uint64)) % np.uint64(homes)).astype(np.int64)


def packed_runs(s: Stretch, head: np.ndarray, where: np.ndarray, group: np.ndarray, window: int) -> pd.DataFrame:
    """Runs by group, each group's heads as one binary and their words as another."""
    order = np.argsort(group, kind="stable")
    head, where, group = head[order], where[order], group[order]
    length = head["n"].astype(np.int64) + window - 1
    words = s.words[ranges(where, length)]
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends, upto = np.r_[cuts[1:], len(group)], np.r_[0, np.cumsum(length)]
    return pd.DataFrame({
        "key": group[cuts],
        "heads": [head[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)],
        "words": [words[upto[a] : upto[b]].tobytes() for a, b in zip(cuts, ends, strict=True)],
        "known": False,
    })


def subtree(head: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a group's runs in the order of their first ``window`` words, the
    earlier place first, and how many words each has in common with the one before it."""
    n = head["n"].astype(np.int64)
    length = n + window - 1
    start = ranges(np.cumsum(length) - length, n)
    place = np.zeros(len(start), PLACE)
    for c in ("doc", "name"):
        place[c] = np.repeat(head[c], n)
    place["at"] = ranges(head["at"].astype(np.int64), n)
    order = np.lexsort((place["at"], place["name"], place["doc"]))
    order = order[np.r_[True, place[order][1:] != place[order][:-1]]]
    rank = np.unique(words, return_inverse=True)[1]
    width = 2 if len(rank) == 0 or rank.max() < 1 << 16 else 4
    rows = np.lib.stride_tricks.sliding_window_view(rank.astype(f">u{width}"), window)[start[order]]  # big-endian: bytes sort as ranks do
    by_words = np.argsort(np.ascontiguousarray(rows).view(f"S{window * width}").ravel(), kind="stable")
    rows = rows[by_words].view(f"<u{width}")
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
    return place[order][by_words], np.r_[0, common]


def subtrees(runs: DataFrame, window: int, homes: int) -> DataFrame:
    """doc, name, at (binary): places to remove.  In a group, below each deep node of its
    subtree, all but the earliest; they and the places known before meet by document."""

    def remove(part: pd.DataFrame) -> pd.DataFrame:
        if part.known.iloc[0]:
            return pd.DataFrame({"key": -1 - part.key[:1], "rows": [b"".join(part.heads)]})
        place, common = subtree(np.frombuffer(b"".join(part.heads), HEAD), np.frombuffer(b"".join(part.words), "<u8"), window)
        late = place[common >= window]
        return packed(late, homes_of(late, homes))

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        return by_owner(np.frombuffer(b"".join(part["rows"]), PLACE), ["doc", "name"], "at", "at")

    return runs.groupBy("key").applyInPandas(remove, "key long, rows binary").groupBy("key").applyInPandas(gather, "doc long, name long, at binary")


# 4. Documents.


def remains(text: str | None, removed: list[bytes], copy: bool, window: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = words_of(text)
    if copy and len(words) >= window:
        return [], len(words)
    at = np.frombuffer(b"".join(removed), np.int32)
    if not len(at):
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + window, len(words)), -1)
    stays = np.cumsum(edge[:-1]) == 0
    return [w for w, s in zip(words, stays.tolist(), strict=True) if s], len(words)


def judged(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, copy, removed (binaries of starts of removed windows)."""
    counts = np.zeros(len(DEPTHS) * BINS, np.int64)
    for r in prefix_counts(docs, window, gram).collect():  # len(DEPTHS) * BINS rows at most
        counts[r["bin"]] = r.n
    total = int(counts[:BINS].sum())
    named = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("name"))
    keys = named.where("text is not null").select("doc", "name", F.md5(F.col("text").cast("binary")).alias("digest"))
    names = cut(keys.groupBy("digest", "name").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n")))
    several = names.where("n > 1").select("digest", "name", F.col("doc").alias("first"))
    copies = keys.join(several, ["digest", "name"]).where("doc <> first").select("doc", "name", F.lit(True).alias("copy")).distinct()
    homes = max(8, -(-total // group))
    marks = marks_of(docs, window, gram, max(1, -(-2 * total // ((window - gram + 2) * bucket))), homes)
    marks = marks.join(names.select("name", "doc"), "name").groupBy("doc", "name").agg(F.collect_list("codes").alias("codes"))
    marked = named.join(marks, ["doc", "name"]).select("doc_id", "doc", "name", "text", "codes")  # all columns: the texts' exchange is reused below
    removed = subtrees(suffixes(marked, window, gram, Groups(counts, group), homes), window, homes).groupBy("doc", "name").agg(F.collect_list("at").alias("removed"))
    return named.join(removed, ["doc", "name"], "left").join(copies, ["doc", "name"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "removed")


def _each(docs: DataFrame, make, schema: str, window: int, **parameters) -> DataFrame:
    def run(batches):
        for pdf in batches:
            got = [remains(t if isinstance(t, str) else None, [] if r is None else r, bool(c), window) for t, c, r in zip(pdf.text, pdf.copy_, pdf.removed, strict=True)]
            yield make(pdf, got)

    return judged(docs, window, **parameters).withColumnRenamed("copy", "copy_").mapInPandas(frugal(run), schema)


def digests(docs: DataFrame, window: int = WINDOW, **parameters) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""

    def make(pdf, got):
        return pd.DataFrame({"doc_id": pdf.doc_id, "n_words": [n for _, n in got], "n_removed": [n - len(w) for w, n in got], "kept_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in got]})

    return _each(docs, make, "doc_id long, n_words long, n_removed long, kept_sha256 string", window, **parameters)


def kept(docs: DataFrame, window: int = WINDOW, **parameters) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text: the words that stay, by single spaces; a
    text that loses nothing is unchanged."""

    def make(pdf, got):
        return pd.DataFrame({"doc_id": pdf.doc_id, "text": pd.Series([t if n == len(w) else b" ".join(w).decode("utf-8", "surrogatepass") for t, (w, n) in zip(pdf.text, got, strict=True)], dtype=object, index=pdf.index)})

    return _each(docs, make, "doc_id long, text string", window, **parameters)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM w),
g AS (SELECT doc_id, pos, w[pos] AS word,
             CASE WHEN pos + 19 <= len(w) THEN array_to_string(list_slice(w, pos, pos + 19), ' ') END AS g FROM p),
f AS (SELECT *, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1 AS late FROM g),
c AS (SELECT *, coalesce(bool_or(late) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
