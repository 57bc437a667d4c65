"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns find e-mail addresses, IPv4 addresses, card numbers that pass the
Luhn test and international phone numbers.  They are searched where they can
be: around an ``@``, or in texts with a digit, each in time linear in the text.

The field labels tokens (runs of non-space) as nothing or one of the four
kinds from the shapes of the token and its neighbours.  It is trained, by
gradient ascent on the conditional likelihood with forward-backward sums,
from a small labelled table that ``examples`` builds by rule.  Tokens without
a digit and without ``@`` are clamped to nothing, so a text falls into short
runs of other tokens, which are exactly the chains that Viterbi decodes, in
numpy batches of runs of like length.  Labels have no mark for where an item
begins, so a labelled run is cut into parts that pass the plain test of their
kind and touch no pattern's span: those that cover most tokens, then with the
fewest line ends or signs of a new item inside, then the fewest.  Each part is
a span; pattern spans always stay.

One pass, no shuffle, whole texts.  Null or empty text: no spans.  Null or
repeated doc_id: rows stay.  Empty table: no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import documents, frugal, mapped

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_NUMBER = re.compile(r"[^0-9 ().+-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i & 1:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = after = m.end()
        else:
            free = at + 1
        at = text.find("@", after)
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    spans: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        spans["email"] = emails(text)
    if DIGIT.search(text):
        if "." in text:
            spans["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans["card"].append(m.span())
        if "+" in text:
            spans["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return spans


# The field.

#: From a token's first digit or ``@`` to its end.
FROM_MARK = re.compile(r"[0-9@]\S*")
RUNS = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]")
EDGE = "\"'`,;:!?<>[]{}|*#%&$"


def marked(text: str) -> Iterator[Span]:
    """Tokens with a digit or ``@``; each character is looked at twice at most."""
    free = 0
    for m in FROM_MARK.finditer(text):
        start = m.start()
        while start > free and not text[start - 1].isspace():
            start -= 1
        yield start, (free := m.end())


def shape(token: str) -> str:
    """Runs of one class with their length, up to eight runs."""
    return _shape(token) if len(token) <= 40 else _shape.__wrapped__(token)


@functools.lru_cache(1 << 16)
def _shape(token: str) -> str:
    parts = []
    for m in RUNS.finditer(token):
        r = m[0]
        if r[0].isdigit() and r[0] < "\x80":
            parts.append(f"d{min(len(r), 20)}")
        elif "A" <= r[0] <= "Z":
            parts.append("A")
        elif "a" <= r[0] <= "z":
            parts.append("a")
        else:
            parts.append(r if r in ".-+()@/=:_" else "?")
        if len(parts) == 8:
            break
    return "".join(parts)


def token_features(tokens: list[str], i: int) -> list[str]:
    """Features of token i among ``tokens``, whose ends are the text's neighbours."""
    own = tokens[i].strip(EDGE)
    digits = sum("0" <= c <= "9" for c in own)
    letters = sum(c.isalpha() for c in own)
    before, after = (shape(tokens[i - 1].strip(EDGE)) if i else "^"), (shape(tokens[i + 1].strip(EDGE)) if i + 1 < len(tokens) else "$")
    return [
        f"s={shape(own.rstrip('.'))}", f"n={min(digits, 20)}", f"l={min(letters, 3)}", f"@={'@' in own}", f"dots={min(own.rstrip('.').count('.'), 4)}",
        f"first={own[:1] if own[:1] in '+(#' else ''}", f"b={before}", f"a={after}", f"nb={min(digits, 20)}|{before[:2]}", f"na={min(digits, 20)}|{after[:2]}",
    ]


def examples(seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """The labelled table: token sequences with a label each, built by rule."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeionrstlhd"), rng.integers(2, 9)))
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    forms = {
        1: [lambda: f"{word()}@{word()}.{word()[:3]}", lambda: f"{word()}.{num(2)}@{word()}{num(1)}.{word()}.com", lambda: f"{word()}_{word()}@{word()}.org", lambda: f"{word()}{num(3)}@{word()}-{word()}.net"],
        2: [lambda: ".".join(str(x) for x in rng.integers(0, 256, 4))],
        3: [lambda: num(16), lambda: " ".join(num(4) for _ in range(4)), lambda: "-".join(num(4) for _ in range(4)), lambda: f"{num(4)} {num(6)} {num(5)}", lambda: num(19), lambda: num(17)],
        4: [lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"+{num(2)} {num(3)} {num(3)} {num(3)}", lambda: f"+{num(11)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"00{num(2)} {num(3)} {num(6)}", lambda: f"+{num(2)}-{num(2)}-{num(4)}-{num(4)}"],
        0: [lambda: num(4), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: num(2), lambda: f"{num(3)},{num(3)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{word()}{num(2)}", lambda: f"{word()}={hashlib.sha1(word().encode()).hexdigest()[:18]}", lambda: hashlib.sha1(word().encode()).hexdigest(), lambda: f"v{num(1)}.{num(2)}", lambda: f"{num(2)}%", lambda: f"${num(3)}.{num(2)}", lambda: f"AK{num(2)}{word().upper()}{num(1)}", lambda: f"{num(2)}:{num(2)}", lambda: f"({num(4)})", lambda: f"{num(1)}.", lambda: f"@{word()}", lambda: f"http://{word()}.{word()}/{num(3)}", lambda: num(6), lambda: num(8), lambda: f"{num(3)} {num(4)}"],
    }
    table = []
    for _ in range(60):
        for label, makers in forms.items():
            for make in makers:
                tokens, labels = [], []
                for part, own in ((word(), 0), (make(), label), (word(), 0)):
                    pieces = part.split(" ")
                    tokens += pieces
                    labels += [own] * len(pieces)
                if rng.random() < 0.3:
                    tokens[-2] += rng.choice([".", ",", ";"])
                table.append((tokens, labels))
    return table


class Field:
    """Emission weights by feature, transitions, and their training."""

    def __init__(self, table: list[tuple[list[str], list[int]]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-3):
        self.index: dict[str, int] = {}
        rows = [[[self.index.setdefault(f, len(self.index)) for f in token_features(t, i)] for i in range(len(t))] for t, _ in table]
        n, longest, width = len(table), max(len(t) for t, _ in table), len(rows[0][0])
        x = np.zeros((n, longest, width), np.int64)
        y, on = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        free = np.zeros((n, longest), bool)
        for k, (tokens, labels) in enumerate(table):
            m = len(tokens)
            x[k, :m], y[k, :m], on[k, :m] = rows[k], labels, True
            free[k, :m] = [bool(FROM_MARK.search(t)) for t in tokens]
        size = len(LABELS)
        self.weights, self.step = np.zeros((len(self.index), size)), np.zeros((size, size))
        gw, gs = np.full_like(self.weights, 1e-8), np.full_like(self.step, 1e-8)
        for _ in range(rounds):
            score = self.weights[x].sum(axis=2)
            score[~free, 1:] = -1e9
            one, two = self._expect(score, on)
            diff = -one
            np.put_along_axis(diff, y[..., None], np.take_along_axis(diff, y[..., None], 2) + 1, 2)
            diff *= on[..., None]
            g = np.zeros_like(self.weights)
            for w in range(width):
                np.add.at(g, x[:, :, w][on], diff[on])
            s = -two
            both = on[:, :-1] & on[:, 1:]
            np.add.at(s, (y[:, :-1][both], y[:, 1:][both]), 1)
            g, s = g / n - ridge * self.weights, s / n - ridge * self.step
            gw += g * g
            gs += s * s
            self.weights += rate * g / np.sqrt(gw)
            self.step += rate * s / np.sqrt(gs)
        self.weights = np.vstack([self.weights, np.zeros(size)])  # a feature not seen in training

    def _expect(self, score: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each token, and expected counts of label pairs."""
        n, length, size = score.shape
        log = lambda v, axis: v.max(axis=axis) + np.log(np.exp(v - v.max(axis=axis, keepdims=True)).sum(axis=axis))
        ahead, back = score.copy(), np.zeros_like(score)
        for t in range(1, length):
            after = log(ahead[:, t - 1, :, None] + self.step, 1) + score[:, t]
            ahead[:, t] = np.where(on[:, t, None], after, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            before = log(self.step + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(on[:, t + 1, None], before, 0)
        total = log(ahead[:, -1], 1)
        one = np.exp(ahead + back - total[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + self.step + (score + back)[:, 1:, None, :] - total[:, None, None, None])
        return one, (pair * (on[:, :-1] & on[:, 1:])[..., None, None]).sum(axis=(0, 1))

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Scores of a chain whose first and last tokens are its neighbours."""
        unseen = len(self.index)
        own = [(shape(t.strip(EDGE)), t) for t in tokens]
        known: dict[tuple, int] = {}  # a token between neighbours of like shapes has like features
        rows, at = [], []
        for i in range(1, len(tokens) - 1):
            key = own[i - 1][0], own[i][1], own[i + 1][0]
            if key not in known:
                known[key] = len(rows)
                rows.append([self.index.get(f, unseen) for f in token_features(tokens, i)])
            at.append(known[key])
        return self.weights[np.array(rows)].sum(axis=1)[at]

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of chains that begin and end beside label 0, by Viterbi in batches."""
        by_length = defaultdict(list)
        for k, c in enumerate(chains):
            by_length[len(c)].append(k)
        out: list = [None] * len(chains)
        for length, members in by_length.items():
            score = np.stack([chains[k] for k in members])
            best = score[:, 0] + self.step[0]
            back = np.zeros((len(members), length, len(LABELS)), np.int64)
            for t in range(1, length):
                way = best[:, :, None] + self.step
                back[:, t] = way.argmax(axis=1)
                best = way.max(axis=1) + score[:, t]
            label = (best + self.step[:, 0]).argmax(axis=1)
            path = np.zeros((len(members), length), np.int64)
            for t in range(length - 1, -1, -1):
                path[:, t] = label
                label = back[np.arange(len(members)), t, label]
            for k, p in zip(members, path, strict=True):
                out[k] = p
        return out


@functools.cache
def field() -> Field:
    return Field(examples())


def fits(kind: str, found: str) -> bool:
    """The plain test of a labelled run."""
    digits = sum("0" <= c <= "9" for c in found)
    if kind == "email":
        return 0 < found.find("@") < len(found) - 3
    if kind == "ip":
        return found.count(".") == 3 and 4 <= digits <= 12 and all(p.isdigit() for p in found.split("."))
    if any(c not in "0123456789 ().+-" for c in found):
        return False
    if kind == "card":
        return 13 <= digits <= 19 and luhn("".join(c for c in found if c.isdigit()))
    return 9 <= digits <= 15


#: Tokens of a part at most: each has a digit, and no kind has more digits.
LONGEST = 19


def trimmed(text: str, start: int, end: int) -> Span:
    while start < end and text[start] in EDGE:
        start += 1
    while end > start and (text[end - 1] in EDGE or text[end - 1] == "."):
        end -= 1
    return start, end


#: Digits of a part of each kind.
DIGITS = {"card": (13, 19), "phone": (9, 15)}


class Run:
    """A run of tokens of one label, and sums over it by which any part is tested in constant time."""

    def __init__(self, kind: str, text: str, run: list[Span], taken: list[Span]):
        self.kind, self.text = kind, text
        edges = [trimmed(text, s, e) for s, e in run]
        self.start, self.end = [s for s, _ in edges], [e for _, e in edges]
        starts, furthest = [s for s, _ in taken], list(itertools.accumulate((e for _, e in taken), max))
        before = [bisect.bisect_left(starts, e) for e in self.end]
        #: The furthest end of the patterns' spans that start before a token's end.
        self.reach = [furthest[k - 1] if k else -1 for k in before]
        figures = [DIGIT.findall(text, s, e) for s, e in run]
        self.digits = [0, *itertools.accumulate(map(len, figures))]
        if kind == "email":  # the first @ of the tokens from one on
            self.mark, at = [-1] * len(run), -1
            for k in range(len(run) - 1, -1, -1):
                found = text.find("@", *run[k])
                self.mark[k] = at = found if found >= 0 else at
        elif kind != "ip":
            self._sums(text, run, figures)

    def _sums(self, text: str, run: list[Span], figures: list[list[str]]) -> None:
        wrong = lambda s, e: len(NOT_NUMBER.findall(text, s, e))
        #: Characters that no number has: before a token, in it, and of it from its own start or up to its own end.
        gaps = [0, *(wrong(run[k - 1][1], run[k][0]) for k in range(1, len(run)))]
        self.bad = [0, *itertools.accumulate(wrong(*r) + g for r, g in zip(run, gaps, strict=True))]
        self.left = [wrong(r[0], s) for r, s in zip(run, self.start, strict=True)]
        self.right = [wrong(e, r[1]) for r, e in zip(run, self.end, strict=True)]
        self.gaps = gaps
        #: Luhn sums of the digits so far: digits of even places as they are and the others doubled, and the reverse.
        one, two = [0], [0]
        for k, d in enumerate(itertools.chain.from_iterable(figures)):
            v = ord(d) - 48
            w = v * 2 - 9 * (v > 4)
            one.append(one[-1] + (w if k & 1 else v))
            two.append(two[-1] + (v if k & 1 else w))
        self.luhn = one, two

    def span(self, i: int, j: int) -> Span | None:
        """The span of tokens i to j, if it passes its kind's plain test and touches no pattern's span."""
        start, end = self.start[i], self.end[j]
        if self.reach[j] > start:
            return None
        if self.kind == "email":
            good = start < self.mark[i] < end - 3
        elif self.kind == "ip":
            good = i == j and fits("ip", self.text[start:end])
        else:
            p, q = self.digits[i], self.digits[j + 1]
            least, most = DIGITS[self.kind]
            good = least <= q - p <= most and self.bad[j + 1] - self.bad[i] == self.gaps[i] + self.left[i] + self.right[j]
            if good and self.kind == "card":
                sums = self.luhn[(q - 1) & 1]
                good = (sums[q] - sums[p]) % 10 == 0
        return (start, end) if good else None

    def firsts(self, j: int) -> range:
        """Tokens at which a part that ends with token j may start, the last first."""
        if self.kind == "ip":
            return range(j, j - 1, -1)
        if self.kind == "email":
            return range(j, max(-1, j - LONGEST), -1)
        least, most = DIGITS[self.kind]
        upto = self.digits[j + 1]
        return range(bisect.bisect_right(self.digits, upto - least, 0, j + 1) - 1, bisect.bisect_left(self.digits, upto - most, 0, j + 1) - 1, -1)


def parts(kind: str, text: str, run: list[Span], taken: list[Span]) -> list[Span]:
    """The parts of a run of tokens of one label that are spans; ``taken`` is sorted."""
    tested = Run(kind, text, run, taken)
    # seams[j]: places up to token j where a new item seems to begin
    sign = "@" if kind == "email" else "+"
    new = [j > 0 and (text.find("\n", run[j - 1][1], run[j][0]) >= 0 or text.find(sign, *run[j]) >= 0) for j in range(len(run))]
    seams = list(itertools.accumulate(new))
    if seams[-1] == 0 and (span := tested.span(0, len(run) - 1)):
        return [span]
    best: list[tuple] = [(0, 0, 0)]  # uncovered tokens, seams, parts
    back: list[tuple[int, Span | None]] = [(0, None)]
    for j in range(len(run)):
        a, b, c = best[j]
        low, way = (a + 1, b, c), (j, None)
        for i in tested.firsts(j):
            a, b, c = best[i]
            cost = (a, b + seams[j] - seams[i], c + 1)
            if cost < low and (span := tested.span(i, j)):
                low, way = cost, (i, span)
        best.append(low)
        back.append(way)
    found, j = [], len(run)
    while j:
        j, span = back[j]
        if span:
            found.append(span)
    return found[::-1]


def added(texts: list[str], base: list[dict[str, list[Span]]]) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text, beside the patterns'."""
    model, chains, places = field(), [], []
    taken: dict[int, list[Span]] = {}
    for d, text in enumerate(texts):
        if not text or not ("@" in text or DIGIT.search(text)):
            continue
        taken[d] = sorted(s for spans in base[d].values() for s in spans)
        run: list[Span] = []
        for span in marked(text):
            if run and text[run[-1][1] : span[0]].strip():
                chains.append(run)
                places.append(d)
                run = []
            run.append(span)
        if run:
            chains.append(run)
            places.append(d)
    spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not chains:
        return spans
    score = []
    for d, run in zip(places, chains, strict=True):
        text = texts[d]
        start, end = run[0][0], run[-1][1]
        before, after = text[max(0, start - 64) : start].split(), text[end : end + 64].split()
        score.append(model.emissions([*(before[-1:] or ["^"]), *(text[slice(*span)] for span in run), *(after[:1] or ["$"])]))
    for d, run, path in zip(places, chains, model.decode(score), strict=True):
        text, i = texts[d], 0
        while i < len(run):
            j = i
            while j + 1 < len(run) and path[j + 1] == path[i]:
                j += 1
            if path[i]:
                kind = LABELS[path[i]]
                spans[d] += [(kind, *p) for p in parts(kind, text, run[i : j + 1], taken[d])]
            i = j + 1
    return spans


def find(texts: list[str | None]) -> tuple[list[dict[str, list[Span]]], list[list[tuple[str, int, int]]]]:
    """Pattern spans by kind, and all spans by kind and start, of each text."""
    plain = [t or "" for t in texts]
    base = [base_spans(t) for t in plain]
    more = added(plain, base)
    rank = {k: i for i, k in enumerate(KINDS)}
    every = [sorted([(k, s, e) for k, own in b.items() for s, e in own] + m, key=lambda x: (rank[x[0]], x[1])) for b, m in zip(base, more, strict=True)]
    return base, every


def spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> counts, digest of the pattern spans, all spans."""

    def run(batches):
        for pdf in batches:
            base, every = find([t if isinstance(t, str) else "" for t in pdf.text])
            said = [",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in b[k]) for b in base]
            out = {"doc_id": pdf.doc_id} | {f"n_{k}": [len(b[k]) for b in base] for k in KINDS}
            out["base_sha256"] = [hashlib.sha256(s.encode()).hexdigest() for s in said]
            out["spans"] = [",".join(f"{k}:{s}:{e}" for k, s, e in e_) for e_ in every]
            yield pd.DataFrame(out)

    return docs.select("doc_id", "text").mapInPandas(frugal(run), SCHEMA)


def mask(text: str, every: list[tuple[str, int, int]]) -> str:
    """The text with a mark such as ``<EMAIL>`` in place of each span."""
    out, at = [], 0
    for s, e, kind in sorted((s, e, k) for k, s, e in every):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` (``n_chars`` follows, if there)."""
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch["text"].to_pylist()
            _, every = find(texts)
            new = [t if t is None else mask(t, e) if e else t for t, e in zip(texts, every, strict=True)]
            columns = []
            for name, kind in zip(names, batch.schema, strict=True):
                if name == "text":
                    columns.append(pa.array(new, kind.type))
                elif name == "n_chars":
                    old = batch[name].to_pylist()
                    columns.append(pa.array([len(n) if n is not None and n != t else o for n, t, o in zip(new, texts, old, strict=True)], kind.type))
                else:
                    columns.append(batch[name])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return mapped(docs, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(documents(spark, sf_dir))
