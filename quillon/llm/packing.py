"""Order-preserving packing of documents into training sequences.

The token streams of a partition's documents follow one another in stored
order.  A dynamic programme over the cut points (ends of documents, ends of
sentences, and ``size`` tokens after either where no end is near) chooses the
windows: least padding plus a penalty for each window that ends inside a
document.  ``best[j] = min over i of best[i] + (size - (s_j - s_i)) + p_j`` (and a small cost for each window)
for windows of ``size`` tokens at most is a sliding minimum of
``best[i] + s_i``, which a monotone queue gives in constant time per point;
windows whose length is a power of two need no padding and are tried beside it.

A partition is one run: rows are taken as they are stored, nothing is
shuffled, and a run's last tokens are cut into powers of two if that is
cheaper.  Memory: tokens are held for ``STRETCH`` of them at a time; the programme
is settled whenever that many have gathered, and what follows the last full
window stays for the next round.

Ids: with a tokenizer of the kind ``BY_WORD`` describes, each word between ASCII
white space is tokenised once and remembered, up to a bounded number of words;
that gives the same ids as the whole text, for such a tokenizer drops white space
and joins nothing across it.  Texts with a special token's string, and all texts
for a tokenizer of another kind, go to the tokenizer whole.  A document ends with id 1 and so has a piece even if its text is null
or empty.  Null or repeated doc_id: rows stay.  Empty table: no rows.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frugal

SIZE, END, STRETCH = 2048, 1, 262_144
#: Cost in tokens of ending a window at a sentence, or inside one, and of a window.
AT_SENTENCE, INSIDE, EACH = 4, 64, 16
TOKENIZER = "word_bpe_49k.json"
#: White space after a sentence's last sign; the end id as bytes.
SENTENCE = re.compile(rb"(?<=[.!?])[ \t-\r]+")
LAST = END.to_bytes(4, "little")
SIGNS = b".,;:!?"
#: What a tokenizer does before its model, for its texts to be tokenised by words.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def windows(points: list[int], prices: list[int], size: int, final: bool) -> list[int]:
    """Indices of the chosen cut points.  ``points`` rise from 0 and no step
    exceeds ``size``; ``prices`` are the penalties of cutting there.  Unless
    ``final``, only windows that cannot change any more are kept: those before
    the last ``2 * size`` tokens, and only the larger powers of two are tried.
    """
    n = len(points)
    best, back, key = [0] * n, [0] * n, [0] * n
    queue: deque[int] = deque([0])
    at = {points[0]: 0}
    powers = [size >> p for p in range(1, size.bit_length() if final else 4)]
    for j in range(1, n):
        s = points[j]
        while s - points[queue[0]] > size:
            queue.popleft()
        source = queue[0]
        cost = key[source] + size - s
        for p in powers:
            k = at.get(s - p)
            if k is not None and best[k] < cost:
                cost, source = best[k], k
        best[j] = cost = cost + prices[j] + EACH
        back[j], at[s] = source, j
        key[j] = cost = cost + s
        while queue and key[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    cuts.reverse()
    return cuts if final else [j for j in cuts if points[j] <= points[-1] - 2 * size]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """Text -> ids and the indices after which a sentence ends.  Word -> its ids as bytes.

    ASCII capitals are lowered first, which the tokenizer does anyway.  A word
    of lower-case letters is one pre-token and goes to the model directly; a
    word and the sign after it are two.  Anything else takes the tokenizer's
    whole way.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        kind = json.loads(self.tokenizer.to_str())
        self.by_word = all(kind[part] == how for part, how in BY_WORD.items()) and all(not t["normalized"] for t in kind["added_tokens"])
        self.limit = limit

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if word[-1] in SIGNS and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1:]]
        text = word.decode("utf-8", "surrogatepass")
        if text.isalpha() and (text.isascii() or (text.lower() == text and unicodedata.is_normalized("NFC", text))):
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))])
        else:
            ids = self.whole(text)
        if len(self) < self.limit:
            self[word] = ids
        return ids

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word or (self.special and self.special.search(text)):
            return np.frombuffer(self.whole(text) + LAST, "<u4"), np.zeros(0, np.int64)
        get = self.__getitem__
        parts = [b"".join(map(get, s.split())) for s in SENTENCE.split(text.encode("utf-8", "surrogatepass").lower())]
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // 4
        parts.append(LAST)
        return np.frombuffer(b"".join(parts), "<u4"), ends[:-1]


@functools.cache
def encoder(path: str) -> Encoder:
    """One a Python worker, whatever tasks it runs."""
    return Encoder(path)


class Run:
    """One partition's stream."""

    def __init__(self, number: int, size: int, stretch: int):
        self.size, self.stretch = size, stretch
        self.next_id = number << 33
        self.docs: deque[list] = deque()  # doc_id, ids, ends, tokens already packed
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, ends, 0])
        self.held += len(ids)
        if self.held >= self.stretch:
            yield from self.settle(False)

    def settle(self, final: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        marks, costs, base = [], [], 0
        for _, ids, ends, done in self.docs:
            ends = ends[ends > done]
            marks += [ends + (base - done), [base + len(ids) - done]]
            costs += [np.full(len(ends), AT_SENTENCE), [0]]
            base += len(ids) - done
        at, cost = np.concatenate(marks).astype(np.int64), np.concatenate(costs).astype(np.int64)
        step = self.size // 4
        before = np.concatenate([[0], at[:-1]])
        for g in np.flatnonzero(at - before > step).tolist():  # a stretch without an end near gets cuts inside
            marks.append(np.arange(before[g] + step, at[g], step))
        if final:  # the rest in powers of two
            marks.append([base - (base & (2 * self.size - 1) & -(1 << p)) for p in range(self.size.bit_length())])
        every = np.concatenate(marks).astype(np.int64)
        every = np.unique(np.concatenate([[0], every[(every > 0) & (every <= base)]]))
        price = np.full(len(every), INSIDE)
        order = np.argsort(-cost, kind="stable")  # the cheaper of two reasons is written last
        price[np.searchsorted(every, at[order])] = cost[order]
        points, prices = every.tolist(), price.tolist()
        cuts = windows(points, prices, self.size, final)
        start = 0
        for j in cuts:
            yield from self.emit(points[j] - start)
            start = points[j]

    def emit(self, length: int) -> Iterator[tuple]:
        """The next ``length`` tokens are one sequence."""
        offset = 0
        while offset < length:
            doc = self.docs[0]
            doc_id, ids, _, done = doc
            take = min(length - offset, len(ids) - done)
            piece = ids[done : done + take]
            yield doc_id, done, take, zlib.crc32(piece.tobytes()), len(ids), self.next_id, offset
            offset += take
            doc[3] += take
            if doc[3] == len(ids):
                self.docs.popleft()
        self.held -= length
        self.next_id += 1


def pack(docs: DataFrame, size: int = SIZE, path: str | Callable[[], str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """docs(doc_id, text) -> one row per piece.  ``path``: the tokenizer's file on every executor."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)

    import pyarrow as pa

    def run(batches):
        stream, encode = Run(TaskContext.get().partitionId(), size, stretch), encoder(path)
        types = [pa.int64()] * 7

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                rows.extend(stream.add(doc_id.as_py(), *encode(text.as_py() or "")))
            if rows:
                yield packed(rows)
                rows = []
        rows.extend(stream.settle(True))
        if rows:
            yield packed(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
