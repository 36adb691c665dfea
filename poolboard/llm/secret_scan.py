"""Secrets in texts: fixed patterns, and probabilistic automata inferred from what these patterns find."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolboard.llm.common import map_rows, read_documents, stored

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
#: A text without any of these has no assignment.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Symbols of credentials. Runs of the shortest assigned value's length and more are candidates; a key id or a hex string
#: lies inside a longer one.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LEAST = 6
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
LONG = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: What parts a run: ``NAME=value`` and ``path/value`` hold a value of their own.
PARTED, PARTS = re.compile(r"[^=/]+"), re.compile("[=/]")
#: Strings are learned and scored by their consecutive parts of so many symbols: the prefix tree has a bounded depth.
DEPTH = 64
#: Labelled parts of each kind that an automaton is learned from, by smallest hash.
SAMPLE = 1000
#: Confidence of the test that keeps two states apart, and the probability left for a symbol never seen in a state.
ALPHA, UNSEEN = 0.05, 1e-4
#: Bits by which a format must explain a run better than ordinary runs do.
MARGIN = 4.0
#: A format's own bound: bits per symbol (the end is one) of all but this share of its labelled strings, and this much less.
TAIL, SLACK = 0.01, 0.25
#: Weight of the shorter context in the frequencies of ordinary runs.
BLEND = 32.0
#: Runs a task remembers the outcome of.
REMEMBERED = 200_000
#: Number of a symbol by its byte; 0 stands before and after a run.
CODES = np.zeros(256, dtype=np.int64)
CODES[list(SYMBOLS.encode())] = np.arange(1, len(SYMBOLS) + 1)
BASE = len(SYMBOLS) + 1
LEARNED = "kind int, value string, gram int, n bigint"
SCANNED = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
           "n_format bigint")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, credential), leftmost and non-overlapping within a kind."""
    spans = []
    small = text.lower()
    if any(name in small for name in NAMES):
        spans += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in LONG.finditer(text):
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            spans += [(kind, run.start() + m.start(), run.start() + m.end(), m[0]) for m in pattern.finditer(run[0])]
    return spans


class Covered:
    """What base spans cover, by bisection."""

    def __init__(self, spans: list[tuple]) -> None:
        order = sorted((start, end) for _, start, end, _ in spans)
        self.starts, self.ends = [start for start, _ in order], []
        for _, end in order:
            self.ends.append(max(end, self.ends[-1] if self.ends else 0))

    def touches(self, start: int, end: int) -> bool:
        before = bisect.bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def free_runs(text: str, spans: list[tuple]) -> list[str]:
    """Runs that no base span touches."""
    if not spans:
        return RUN.findall(text)
    covered = Covered(spans)
    return [m[0] for m in RUN.finditer(text) if not covered.touches(m.start(), m.end())]


def variants(run: str, start: int, end: int) -> list[tuple[int, int]]:
    """A place in a run as it is and without signs at its ends, if long enough."""
    part = run[start:end]
    left = start + len(part) - len(part.lstrip("+/_.=-"))
    places = [(start, end), (left, max(left, start + len(part.rstrip("+/_.=-"))))]
    return [(a, b) for a, b in dict.fromkeys(places) if b - a >= LEAST]


def parts(string: str) -> list[str]:
    return [string[at:at + DEPTH] for at in range(0, len(string), DEPTH)]


class Automaton:
    """A probabilistic deterministic automaton: a prefix tree whose compatible states are merged.

    ``after[s]`` has the next state by symbol, ``passed[s]`` how often each symbol was read there, ``ended[s]`` how
    often a string ended there.
    """

    def __init__(self, strings: dict[str, int]) -> None:
        self.after: list[dict[str, int]] = [{}]
        self.passed: list[dict[str, int]] = [{}]
        self.ended = [0]
        for string, times in strings.items():
            state = 0
            for symbol in string:
                if symbol not in self.after[state]:
                    self.after[state][symbol] = len(self.after)
                    self.after.append({})
                    self.passed.append({})
                    self.ended.append(0)
                self.passed[state][symbol] = self.passed[state].get(symbol, 0) + times
                state = self.after[state][symbol]
            self.ended[state] += times
        self.merge_states()
        self.steps = [{s: (math.log2(n / self.visits(r) * (1 - UNSEEN)), self.after[r][s])
                       for s, n in self.passed[r].items()} for r in range(len(self.after))]
        self.ends = [math.log2(max(UNSEEN, self.ended[r] / max(1, self.visits(r)))) for r in range(len(self.after))]
        own = sorted(self.bits(s) / (len(s) + 1) for s in strings)
        self.least = own[int(len(own) * TAIL)] - SLACK if own else 0.0

    def visits(self, state: int) -> int:
        return self.ended[state] + sum(self.passed[state].values())

    def alike(self, a: int, b: int) -> bool:
        """Whether two states and all below them agree within the bounds of Hoeffding's inequality."""
        spread = math.sqrt(0.5 * math.log(2 / ALPHA))
        stack, seen = [(a, b)], set()
        while stack:
            pair = a, b = stack.pop()
            if pair in seen:
                continue
            seen.add(pair)
            n, m = self.visits(a), self.visits(b)
            if not n or not m:
                continue
            bound = spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ended[a] / n - self.ended[b] / m) > bound:
                return False
            mine, theirs = self.passed[a], self.passed[b]
            for symbol in mine.keys() | theirs.keys():
                if abs(mine.get(symbol, 0) / n - theirs.get(symbol, 0) / m) > bound:
                    return False
                if symbol in mine and symbol in theirs:
                    stack.append((self.after[a][symbol], self.after[b][symbol]))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add the counts of a tree to a state and the states it leads to."""
        stack = [(into, tree)]
        while stack:
            into, tree = stack.pop()
            self.ended[into] += self.ended[tree]
            for symbol, count in self.passed[tree].items():
                self.passed[into][symbol] = self.passed[into].get(symbol, 0) + count
                below = self.after[tree][symbol]
                if symbol in self.after[into]:
                    stack.append((self.after[into][symbol], below))
                else:
                    self.after[into][symbol] = below

    def merge_states(self) -> None:
        """Red states stay; a blue one, next to a red one, is merged into the first red state like it, or stays too."""
        red, kept = [0], {0}
        while True:
            blue = next(((r, s, t) for r in red for s, t in sorted(self.after[r].items()) if t not in kept), None)
            if blue is None:
                break
            source, symbol, state = blue
            twin = next((r for r in red if self.alike(r, state)), None)
            if twin is None:
                red.append(state)
                kept.add(state)
            else:
                self.after[source][symbol] = twin
                self.fold(twin, state)
        number = {state: n for n, state in enumerate(red)}
        self.after = [{s: number[t] for s, t in self.after[r].items()} for r in red]
        self.passed = [self.passed[r] for r in red]
        self.ended = [self.ended[r] for r in red]

    def bits(self, string: str, least: float = -math.inf) -> float:
        """log2 likelihood of a string by its parts; an unseen symbol costs much and leads back to the start.

        Likelihoods only fall, so reading ends where one is below ``least``.
        """
        total = 0.0
        for part in parts(string):
            state = 0
            for symbol in part:
                step = self.steps[state].get(symbol)
                if step is None:
                    total, state = total + math.log2(UNSEEN), 0
                else:
                    total, state = total + step[0], step[1]
                if total < least:
                    return -math.inf
            total += self.ends[state]
        return total if total >= least else -math.inf


class Ordinary:
    """Ordinary runs: a symbol's frequencies after the last two, blended with those after one and after none.

    A run was counted itself, so its own grams are left out of the counts that judge it.
    """

    def __init__(self, grams: np.ndarray) -> None:
        three = grams.reshape(BASE, BASE, BASE)
        self.three, self.after_two = three, three.sum(axis=2)
        self.two, self.after_one = three.sum(axis=0), three.sum(axis=(0, 2))
        self.one, self.total = three.sum(axis=(0, 1)), int(three.sum())

    def bits(self, string: str) -> float:
        """log2 likelihood of a run and its end."""
        numbers = gram_numbers([string])
        before, last, symbol = np.unravel_index(numbers, self.three.shape)

        def others(counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
            _, place, own = np.unique(keys, return_inverse=True, return_counts=True)
            return np.maximum(counts - own[place], 0)

        share = (others(self.one[symbol], symbol) + 1) / (max(self.total - len(numbers), 0) + BASE)
        share = ((others(self.two[last, symbol], last * BASE + symbol) + BLEND * share)
                 / (others(self.after_one[last], last) + BLEND))
        share = ((others(self.three[before, last, symbol], numbers) + BLEND * share)
                 / (others(self.after_two[before, last], before * BASE + last) + BLEND))
        return float(np.log2(share).sum())


def gram_numbers(runs: list[str]) -> np.ndarray:
    """Numbers of all runs of three symbols, each run between two ends before it and one behind it."""
    codes = CODES[np.frombuffer(("\0\0" + "\0\0".join(runs) + "\0").encode(), dtype=np.uint8)]
    numbers = (codes[:-2] * BASE + codes[1:-1]) * BASE + codes[2:]
    # the second of two ends is no symbol to be expected
    return numbers[~((codes[2:] == 0) & (codes[1:-1] == 0))]


class Scorer:
    """Places of secrets in a run, remembered for a bounded number of runs."""

    def __init__(self, formats: list[Automaton], ordinary: Ordinary, margin: float) -> None:
        self.formats, self.ordinary, self.margin = formats, ordinary, margin
        self.known: dict[str, list[tuple[int, int]]] = {}

    def gain(self, value: str) -> float:
        """Bits by which a format explains a value better than ordinary runs do; minus infinity if it is no secret.

        The format has to explain it as well as its own credentials, too, and the gain to reach the margin.
        """
        best = max((f.bits(value, f.least * (len(value) + 1)) for f in self.formats), default=-math.inf)
        if best == -math.inf:
            return best
        gain = best - self.ordinary.bits(value)
        return gain if gain >= self.margin else -math.inf

    def best(self, run: str, start: int, end: int) -> tuple[float, int, int]:
        """The better of a place's variants, the longer one of equals."""
        found = [(self.gain(run[a:b]), a, b) for a, b in variants(run, start, end)]
        return max(found, key=lambda f: f[0], default=(-math.inf, start, end))

    def places(self, run: str) -> list[tuple[int, int]]:
        """Secrets of a run: all of it, or its parts between ``=`` and ``/`` if one of them gains more than all of it."""
        taken = self.known.get(run)
        if taken is None:
            whole = self.best(run, 0, len(run))
            inner = [self.best(run, m.start(), m.end()) for m in PARTED.finditer(run)] if PARTS.search(run) else []
            tried = inner if max(inner, default=whole)[0] > whole[0] else [whole]
            taken = [(a, b) for gain, a, b in tried if gain > -math.inf]
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(run) <= DEPTH:
                self.known[run] = taken
        return taken

    def spans(self, text: str, base: list[tuple]) -> list[tuple[int, int, int]]:
        """``format`` spans of a text beside its base spans."""
        if not self.formats or not any(self.places(run) for run in RUN.findall(text)):
            return []
        covered = Covered(base)
        return [(3, m.start() + a, m.start() + b) for m in RUN.finditer(text) for a, b in self.places(m[0])
                if not covered.touches(m.start() + a, m.start() + b)]


def learn(texts: DataFrame, sample: int) -> tuple[list[Automaton], Ordinary]:
    """Of a frame of texts: one automaton per kind of credential, and the counts of all other runs.

    An automaton is learned from at most ``sample`` distinct parts. Tasks cut credentials into parts of ``DEPTH`` symbols and count three-symbol grams of all other runs in an array; the
    driver gets ``sample`` parts a kind and one number per gram (at most 69 to the third), however long the runs are.
    """
    def search(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        grams = np.zeros(BASE ** 3, dtype=np.int64)
        for rows in slices:
            labelled, ordinary = set(), []
            for text, in rows:
                spans = base_spans(text or "")
                labelled.update((kind, part) for kind, _, _, value in spans for part in parts(value))
                ordinary += free_runs(text or "", spans)
            if ordinary:
                grams += np.bincount(gram_numbers(ordinary), minlength=BASE ** 3)
            yield [(kind, part, None, 1) for kind, part in sorted(labelled)]
        yield [(None, None, int(n), int(grams[n])) for n in grams.nonzero()[0]]

    found = stored(map_rows(texts, search, LEARNED), "secrets")
    order = W.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    picked = (found.where("kind is not null").select("kind", "value").distinct()
              .withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).collect())
    strings = [{r["value"]: 1 for r in sorted(picked) if r["kind"] == kind} for kind in range(3)]
    grams = np.zeros(BASE ** 3, dtype=np.int64)
    for gram, n in found.where("kind is null").groupBy("gram").agg(F.sum("n")).collect():
        grams[gram] = n
    return [Automaton(s) for s in strings if s], Ordinary(grams)


def joined(spans: list[tuple]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2]))])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
         margin: float = MARGIN) -> DataFrame:
    """Secrets of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format.

    A first scan gathers credentials and the frequencies of symbols in all other runs; automata are learned from a
    bounded sample of the credentials. A second one scores every run of six and more credential symbols, letters alone
    too: all of it or its parts between ``=`` and ``/``, with or without signs around, whichever gains most. What a
    format explains, ``margin`` bits better than ordinary runs, becomes a ``format`` span unless a base span touches it.
    Spans are ``kind:start:end`` over whole matches in code points, end exclusive, by start, then kind.

    Null counts as empty: no spans, the hash of the empty string. Repeated rows and null ids: each scanned for itself.
    Very long runs are learned and scored by their consecutive parts of 64 symbols. Of equal gains the whole
    and the longer one stay. Without any credential in the table there are no automata and no ``format`` spans. An
    empty table gives no rows.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    formats, ordinary = learn(docs.select("text"), sample)

    def score(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        scorer = Scorer(formats, ordinary, margin)
        for rows in slices:
            out = []
            for key, value in rows:
                found = base_spans(value or "")
                spans = [span[:3] for span in found]
                counts = [sum(kind == k for kind, _, _ in spans) for k in range(3)]
                more = scorer.spans(value or "", found)
                out.append((key, *counts, hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans + more),
                            len(more)))
            yield out

    return map_rows(docs, score, SCANNED)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(read_documents(spark, sf_dir))
