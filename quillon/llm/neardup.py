"""Near-duplicate documents by MinHash with odd sketches.

A document's set is its distinct word shingles (letters A-Z in lower case).
Documents with ``100 * |intersection| >= percent * |union|`` are linked, and a
group is what links connect.

1. One pass over the texts gives each document its set's digest, band keys
   (``BANDS`` bands of ``ROWS`` MinHash samples) and an odd sketch: the samples,
   folded into ``BITS`` parity bits.  Equal sets become one class, so copies
   cost no pairs.
2. Every class is paired with the least and the greatest class of each of its
   band buckets.  The population count of the XOR of two odd sketches estimates
   how many samples differ, and so the similarity; pairs well below the bound
   are dropped.  What stays connects candidates into clusters.  A bucket whose
   other classes are in several clusters then compares the sketches of all
   pairs from different clusters, in blocks, and what passes joins the clusters:
   each pair that shares a bucket is in one cluster or was rejected by its sketches.
3. Full sets confirm: every member against its cluster's least member, its hub.
   Members confirmed against the hub need no pairs among themselves; the others
   may be linked to any member, and each cluster takes the cheaper of two exact
   ways.  In blocks they meet all members, and a block gives only links that
   join groups.  Or they meet the members that share a rare shingle: of two
   linked sets the rarest ``n - ceil(percent n / 100) + 1`` shingles have one in
   common, in any order of the shingles, here by counts in some of the cluster's
   rows.  That keeps a site whose pages share a template, but little else, from
   all its pairs.  The ways' costs are the sets to move, counted beforehand.
4. The links' components are the groups.

Chances: a pair at similarity s shares no band with probability
``(1 - s ** ROWS) ** BANDS``: 5e-11 at 0.85, 5e-8 at 0.8.

Scale: no bucket or cluster is gathered in one place.  Buckets are minima and
maxima with partial aggregation; ``SPOKES`` members share a copy of their hub;
blocks have ``BLOCK`` rows of sets or ``CROWD`` of sketches, and a shingle's rows
are dealt into parts of ``BLOCK``.  A bucket's pairs outside its largest cluster
are quadratic in sketches, in numpy, and so are a cluster's whose members are
nearly all alike but not linked with the hub; no pair of them is left out.  Text
moves once, to meet the members of clusters.

Fewer words than a shingle: the whole sequence is the one shingle.  Null text
or text without words: empty set, linked with nothing.  Null doc_id: linked
with nothing, its component null, not kept.  Rows with one doc_id are one node.
Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCodes, columns, cut, documents, forget, frugal, mix, shift_pair, stored
from .graph import components

SHINGLE, PERCENT = 5, 80
BANDS, ROWS, BITS, SEED, BLOCK, CROWD = 32, 4, 512, 31, 256, 1024
#: Members that meet one copy of their hub; keys of a cluster known to be common.
SPOKES, COMMON = 4096, 8192
#: An estimate so far below the bound drops a pair: six standard errors and more.
SLACK = 0.25


def shingles(text: str | None, codes: WordCodes, k: int) -> np.ndarray:
    """Sorted distinct codes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    c = codes.of(words)
    n = max(1, len(c) - k + 1)
    key = np.full(n, min(k, len(c)), np.uint64)
    for d in range(min(k, len(c))):
        key = shift_pair(key, c[d : d + n])
    return np.unique(key)


class Signer:
    def __init__(self, bands: int, rows: int, bits: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.a = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        self.salt = mix(np.arange(1, k + 1, dtype=np.uint64))
        self.bands, self.rows, self.bits = bands, rows, bits

    def samples(self, keys: np.ndarray, step: int = 1024) -> np.ndarray:
        low = None
        for s in range(0, len(keys), step):
            part = ((keys[s : s + step, None] ^ self.b) * self.a).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low

    def sign(self, keys: np.ndarray) -> tuple[list[int], list[int]]:
        """Band keys and odd sketch, both as signed 64-bit numbers."""
        low = self.samples(keys)
        grid = low.reshape(self.bands, self.rows)
        band = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            band = shift_pair(band, grid[:, r])
        odd = np.bincount((mix(low ^ self.salt) % np.uint64(self.bits)).astype(np.int64), minlength=self.bits) & 1
        return band.view(np.int64).tolist(), np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def most_odd(similarity: float, samples: int, bits: int) -> int:
    """Odd bits expected in the XOR of two sketches of that similarity."""
    differing = 2 * samples * (1 - similarity)
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** differing))


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    def run(batches):
        signer, codes = Signer(bands, rows, bits), WordCodes()
        for pdf in batches:
            known: dict = {}
            out = []
            for text in pdf.text:
                text = text if isinstance(text, str) else None
                if (got := known.get(text)) is None:
                    keys = shingles(text, codes, shingle)
                    got = (len(keys), xxhash.xxh3_128_digest(keys.tobytes()), *signer.sign(keys)) if len(keys) else (0, None, None, None)
                    known[text] = got
                out.append(got)
            n, digest, band, odd = zip(*out, strict=True) if out else ([],) * 4
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_shingles": n, "digest": pd.Series(digest, dtype=object, index=pdf.index), "bands": pd.Series(band, dtype=object, index=pdf.index), "odd": pd.Series(odd, dtype=object, index=pdf.index)})

    return docs.select("doc_id", "text").mapInPandas(frugal(run), "doc_id long, n_shingles long, digest binary, bands array<long>, odd array<long>")


def confirmed(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both)


class Joined:
    """Union-find over the ids of a block."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def block_links(ids: list[int], sets: list[np.ndarray], lone: list[bool], asks: list[bool], percent: int, hub: int) -> list[tuple[int, int]]:
    """Links of the asking rows with all rows of a block that join groups.
    Rows that aren't lone are already in the hub's group."""
    groups, links = Joined(), []
    for i, alone in zip(ids, lone, strict=True):
        if not alone:
            groups.join(hub, i)
    sizes = np.array([len(s) for s in sets])
    keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    for i in np.flatnonzero(asks).tolist():
        start, end = np.searchsorted(keys, sets[i]), np.searchsorted(keys, sets[i], side="right")
        length = end - start
        at = np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)).tolist():
            if ids[i] != ids[j] and groups.join(ids[i], ids[j]):
                links.append((ids[i], ids[j]))
    return links


def crowd_links(group: np.ndarray, cluster: np.ndarray, odd: np.ndarray, asks: np.ndarray, most: int, step: int = 1 << 18) -> list[tuple[int, int]]:
    """Links between clusters that sketches allow: in each group (its rows are
    neighbours) of the asking rows with all others.  Links that join nothing are left out."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    own = np.repeat(np.arange(len(start)), size)
    who, joined, found = np.flatnonzero(asks), Joined(), []
    turn = np.cumsum(size[own[who]]) // step
    for part in np.split(who, np.flatnonzero(np.diff(turn)) + 1):
        length = size[own[part]]
        at = np.arange(length.sum()) + np.repeat(start[own[part]] - (np.cumsum(length) - length), length)
        by = np.repeat(part, length)
        apart = cluster[by] != cluster[at]
        by, at = by[apart], at[apart]
        close = np.bitwise_count(odd[by] ^ odd[at]).sum(axis=1) <= most
        pairs = np.unique(np.sort(np.stack([cluster[by[close]], cluster[at[close]]], axis=1), axis=1), axis=0)
        found += [(a, b) for a, b in pairs.tolist() if joined.join(a, b)]
    return found


def crowded(met: DataFrame, placed: DataFrame, most: int, crowd: int) -> DataFrame:
    """Links (a, b) between the clusters of ``placed(rep, odd, cluster)`` by the pairs of a
    bucket of ``met(key, rep, lo, hi)`` that were not compared with its ends."""
    rest = met.where("rep <> lo and rep <> hi").select("key", "rep").join(placed.select("rep", "odd", "cluster"), "rep")
    shares = rest.groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    shares = shares.agg(F.max(F.struct("n", "cluster")).alias("main"), F.sum("n").alias("members")).where("main.n < members")
    shares = shares.select("key", F.col("main.cluster").alias("main"), F.ceil((F.col("members") - F.col("main.n")) / crowd).cast("int").alias("ask_blocks"), F.ceil(F.col("members") / crowd).cast("int").alias("blocks"))
    rest = rest.join(shares, "key")
    asks = rest.where("cluster <> main").select("key", "cluster", "odd", F.lit(True).alias("asks"), dealt("a", "ask_blocks", "rep").alias("i"), every("blocks").alias("j"))
    told = rest.select("key", "cluster", "odd", F.lit(False).alias("asks"), every("ask_blocks").alias("i"), dealt("m", "blocks", "rep").alias("j"))

    def compare(batches):
        held = None
        for pdf in batches:
            part = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = (part[["key", "i", "j"]].to_numpy()[1:] != part[["key", "i", "j"]].to_numpy()[:-1]).any(axis=1)
            last = int(np.flatnonzero(np.r_[True, new])[-1]) if len(part) else 0
            held = part.iloc[last:]
            yield linked(part.iloc[:last], new[: max(0, last - 1)])
        if held is not None and len(held):
            yield linked(held, np.zeros(len(held) - 1, bool))

    def linked(part: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
        found = crowd_links(np.r_[0, np.cumsum(new)], part.cluster.to_numpy(), np.stack(part.odd.to_numpy()), part.asks.to_numpy(bool), most) if len(part) else []
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype=np.int64)

    blocks = asks.unionByName(told).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return blocks.mapInPandas(frugal(compare), "a long, b long")


def links(docs: DataFrame, reps: DataFrame, shingle: int, percent: int, bands: int = BANDS, rows: int = ROWS, bits: int = BITS, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """Confirmed links (a, b) between class representatives ``reps(rep, bands, odd)``
    that connect what all links connect."""
    entries = reps.select("rep", F.explode("bands").alias("key"))
    ends = entries.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    met = cut(entries.join(ends, "key"))
    pairs = met.select("rep", F.explode(F.array("lo", "hi")).alias("end")).where("rep <> end")
    pairs = pairs.select(F.least("rep", "end").alias("a"), F.greatest("rep", "end").alias("b")).distinct()
    odd = reps.select("rep", "odd")
    pairs = pairs.join(odd.select(F.col("rep").alias("a"), F.col("odd").alias("x")), "a").join(odd.select(F.col("rep").alias("b"), F.col("odd").alias("y")), "b")
    differing = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
    most = most_odd(percent / 100 - SLACK, bands * rows, bits)
    found = components(pairs.where(differing <= most).select("a", "b"))
    placed = cut(odd.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "odd", F.coalesce("component", "rep").alias("cluster"), F.col("component").isNotNull().alias("linked")))
    wider = components(crowded(met, placed, most, crowd)).select(F.col("node").alias("cluster"), F.col("component").alias("wide"))
    member = placed.join(wider, "cluster", "left").where("linked or wide is not null")
    member = member.select(F.col("rep").alias("doc_id"), F.coalesce("wide", "cluster").alias("cluster"))
    shares = member.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / SPOKES).cast("int").alias("shares"))
    member = cut(member.join(shares, "cluster").withColumn("share", dealt("s", "shares")))
    forget(met)

    def gather(batches):
        codes = WordCodes()
        for pdf in batches:
            sets = [shingles(t, codes, shingle).tobytes() for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "cluster": pdf.cluster, "share": pdf["share"], "shares": pdf.shares, "keys": pd.Series(sets, dtype=object, index=pdf.index)})

    sets = docs.select("doc_id", "text").where("text is not null").join(member, "doc_id").mapInPandas(frugal(gather), "doc_id long, cluster long, share int, shares int, keys binary")
    sets = cut(sets)

    def against(batches):
        for pdf in batches:
            hit = [a == c or confirmed(np.frombuffer(k, np.uint64), np.frombuffer(h, np.uint64), percent) for a, c, k, h in zip(pdf.doc_id, pdf.cluster, pdf["keys"], pdf["hub"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "cluster": pdf.cluster, "keys": pdf["keys"], "hit": hit})

    hubs = sets.where("doc_id = cluster").dropDuplicates(["cluster"]).select("cluster", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("keys").alias("hub"))
    rest = cut(sets.join(hubs, ["cluster", "share"]).mapInPandas(frugal(against), "doc_id long, cluster long, keys binary, hit boolean"))
    forget(sets)
    star = rest.where("hit and doc_id <> cluster").select(F.col("cluster").alias("a"), F.col("doc_id").alias("b"))
    # clusters of more than the hub and its friends; stored, so that Spark knows how small the table is
    size = rest.groupBy("cluster").agg(F.count_if(~F.col("hit")).alias("askers"), F.count(F.lit(1)).alias("members")).where("askers > 0 and members > 2")
    size = stored(size.select("cluster", F.ceil(F.col("askers") / block).cast("int").alias("ask_blocks"), F.ceil(F.col("members") / block).cast("int").alias("blocks")), "clusters")
    large = size.where("blocks > 1")
    prefixes = cut(rare_prefixes(rest.join(large, "cluster"), percent, block))
    shared = prefixes.groupBy("cluster", "key").agg(F.count_if("asks").alias("a"), F.count(F.lit(1)).alias("m")).where("a > 0 and m > 1")
    cost = shared.groupBy("cluster").agg(F.sum(F.col("a") * F.col("m")).alias("pairs"))
    by_pairs = large.join(cost, "cluster", "left").where(F.coalesce("pairs", F.lit(0)) <= F.col("ask_blocks") * F.col("blocks") * block)
    by_pairs = stored(by_pairs.select("cluster"), "sparse")
    few = paired(prefixes.join(by_pairs, "cluster", "left_semi"), shared, rest.join(by_pairs, "cluster", "left_semi"), percent, block)
    return star.unionByName(few).unionByName(blocked(rest.join(size.join(by_pairs, "cluster", "left_anti"), "cluster"), percent))


def dealt(salt: str, n: str, by: str = "doc_id") -> Column:
    """One of the ``n`` parts for a row, by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit(salt), by), F.col(n)).cast("int")


def every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def blocked(rest: DataFrame, percent: int) -> DataFrame:
    """Links of ``rest(cluster, doc_id, keys, hit, ask_blocks, blocks)`` that join groups: in each
    cluster, blocks of the rows that missed the hub meet blocks of all rows."""
    asks = rest.where("not hit").select("cluster", "doc_id", "keys", "hit", F.lit(True).alias("asks"), dealt("a", "ask_blocks").alias("i"), every("blocks").alias("j"))
    told = rest.select("cluster", "doc_id", "keys", "hit", F.lit(False).alias("asks"), every("ask_blocks").alias("i"), dealt("m", "blocks").alias("j"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "asks"])
        found = block_links(part.doc_id.tolist(), [np.frombuffer(k, np.uint64) for k in part["keys"]], (~part.hit).tolist(), part.asks.to_numpy(bool), percent, int(part.cluster.iloc[0]))
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype=np.int64)

    return asks.unionByName(told).groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")


def common_keys(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The commonest keys that two sets or more hold, sorted, with their counts."""
    key, n = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in sets]), return_counts=True)
    top = np.sort(np.argsort(-n, kind="stable")[:COMMON])
    top = top[n[top] > 1]
    return key[top], n[top]


def rare_prefix(keys: np.ndarray, known: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """The rarest keys of a set, so many that a set linked with it has one of them among its own."""
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    seen = np.where(known[at] == keys, count[at], 0) if len(known) else np.zeros(len(keys), np.int64)
    need = -(-percent * len(keys) // 100)
    return keys[np.lexsort((mix(keys), seen))[: len(keys) - need + 1]]


def rare_prefixes(large: DataFrame, percent: int, block: int) -> DataFrame:
    """cluster, key, doc_id, n, asks: the rare prefixes of the rows of large clusters.

    What is rare in a cluster is judged by some ``block`` of its rows.  That decides the order
    of keys, any of which is right, and so only how many pairs there are to confirm.
    """

    def common(part: pd.DataFrame) -> pd.DataFrame:
        key, n = common_keys(part["keys"].tolist())
        return pd.DataFrame({"cluster": part.cluster[:1], "blocks": part.blocks[:1], "known": [key.tobytes()], "counts": [n.astype(np.int64).tobytes()]})

    def cut_off(part: pd.DataFrame) -> pd.DataFrame:
        head = part[part.known.notna()]
        known, counts = (np.frombuffer(head[c].iloc[0], t) if len(head) else np.zeros(0, t) for c, t in (("known", np.uint64), ("counts", np.int64)))
        rows = part[part["keys"].notna()]
        own = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
        found = [rare_prefix(k, known, counts, percent) for k in own]
        length = np.array([len(k) for k in found], np.int64)
        again = lambda values: np.repeat(np.asarray(values), length)
        return pd.DataFrame({"cluster": again(rows.cluster), "key": np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64), "doc_id": again(rows.doc_id), "n": again([len(k) for k in own]), "asks": again(~rows.hit.astype(bool))})

    some = large.where(F.pmod(F.xxhash64(F.lit("c"), "doc_id"), F.col("blocks")) == 0)
    heads = some.select("cluster", "blocks", "keys").groupBy("cluster").applyInPandas(common, "cluster long, blocks int, known binary, counts binary")
    none = lambda kind: F.lit(None).cast(kind)
    heads = heads.select("cluster", every("blocks").alias("i"), "known", "counts", none("long").alias("doc_id"), none("binary").alias("keys"), none("boolean").alias("hit"))
    rows = large.select("cluster", dealt("p", "blocks").alias("i"), none("binary").alias("known"), none("binary").alias("counts"), "doc_id", "keys", "hit")
    return heads.unionByName(rows).groupBy("cluster", "i").applyInPandas(cut_off, "cluster long, key long, doc_id long, n long, asks boolean")


def paired(prefixes: DataFrame, shared: DataFrame, rest: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of rows of one cluster that share a rare key, one of them a row that missed the hub."""
    rows = prefixes.join(shared.select("cluster", "key", F.ceil(F.col("m") / block).cast("int").alias("parts")), ["cluster", "key"])
    asks = rows.where("asks").select("cluster", "key", F.col("doc_id").alias("x"), F.col("n").alias("x_n"), every("parts").alias("part"))
    told = rows.select("cluster", "key", F.col("doc_id").alias("y"), F.col("n").alias("y_n"), F.col("asks").alias("y_asks"), dealt("k", "parts").alias("part"))
    alike = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    pairs = asks.join(told, ["cluster", "key", "part"]).where(alike & F.expr("x <> y and not (y_asks and x > y)")).select("x", "y").distinct()
    left, right = (rest.select(F.col("doc_id").alias(c), F.col("keys").alias(f"{c}_keys")) for c in "xy")

    def check(batches):
        for pdf in batches:
            hit = np.array([confirmed(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(pdf.x_keys, pdf.y_keys, strict=True)], bool)
            yield pd.DataFrame({"a": pdf.x[hit], "b": pdf.y[hit]})

    return pairs.join(left, "x").join(right, "y").mapInPandas(frugal(check), "a long, b long")


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, **parameters) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    signed = cut(signatures(docs, shingle, **{k: v for k, v in parameters.items() if k in ("bands", "rows", "bits")}))
    able = signed.where("digest is not null and doc_id is not null")
    classes = cut(able.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "odd"), "doc_id").alias("s")).select("digest", "rep", "s.bands", "s.odd"))
    found = components(links(docs, classes.select("rep", "bands", "odd"), shingle, percent, **parameters))
    same = able.select(F.col("doc_id").alias("a"), "digest").join(classes.select("digest", "rep"), "digest")
    group = same.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("a").alias("doc_id"), F.coalesce("component", "rep").alias("component_id"))
    group = group.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(group, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def distinct(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one document of each group: the one with the least id.
    Documents without an id are in no group and stay."""
    gone = groups(docs, **parameters).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir), shingle=3, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM s GROUP BY doc_id),
rep AS (SELECT digest, min(doc_id) AS rep FROM c GROUP BY digest),
r AS (SELECT rep AS doc_id, g FROM rep JOIN s ON s.doc_id = rep.rep),
rare AS (SELECT *, count(*) OVER (PARTITION BY g) AS df FROM r),
-- two sets at 0.85 or more share one of the first 15 % and one of each set's rarest shingles
p AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k FROM rare),
f AS (SELECT p.doc_id, g FROM p JOIN n USING (doc_id) WHERE k <= n - ceil(0.85 * n) + 1),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.g = y.g AND x.doc_id < y.doc_id),
shared AS (SELECT a, b, count(*) AS i FROM cand JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
walk AS (SELECT rep AS node, rep AS reach FROM rep UNION SELECT walk.node, sym.b FROM walk JOIN sym ON sym.a = walk.reach),
comp AS (SELECT node, min(reach) AS component FROM walk GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id)::BIGINT AS component_id,
       d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN rep USING (digest) LEFT JOIN comp ON comp.node = rep.rep
"""
