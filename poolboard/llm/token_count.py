"""Token counts of whole texts by a compiled finite-state tokenizer.

A byte-pair tokenizer with word ends is compiled into a deterministic transducer over the bytes of a word. Of a word's
prefix only its *last token* matters for what follows: the tokens before it are the tokenization of the shorter prefix.
A state is therefore the longest suffix that begins a token, with the last token and the relative count at each place
in it where another token may still begin; a transition carries how many tokens it emits (a merge takes one back).
States and transitions are made when first met and kept within a bound, as automaton-based matchers do.

Words are separated by white space, which always leads back to the start state. The state map of a chunk of text is
thus its unfinished head, the count between and its unfinished tail. These maps compose associatively: long texts are
cut into chunks, each a row that is mapped on its own, and each round of a parallel scan composes runs of neighbouring
maps as a balanced tree.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolboard.llm.common import arrow_schema, encoded, map_rows, read_documents, stored
from poolboard.llm.tokens import tokenizer_path

LIMIT = 2048
#: Bytes of a chunk of a long text.
CHUNK = 1 << 16
#: Neighbouring maps that one call composes.
FAN = 64
CHUNKS = "row bigint, doc_id bigint, n_bytes bigint, place bigint, bytes binary"
MAPS = "row bigint, doc_id bigint, n_bytes bigint, place bigint, head binary, total bigint, tail binary"
COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: Transitions and words that a worker keeps before it drops them all.
TRANSITIONS, WORDS = 1_000_000, 1_000_000
#: A longer word is counted but not remembered.
WORD_LENGTH = 64
#: The byte values that byte-level vocabularies print as they are; the others are printed as code points from 256 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_of_letter() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + n): b for n, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of words; symbols are bytes, plus 256 for a word's last byte."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_of_letter()
        end = model["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split).findall
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))

        def symbols(token: str) -> tuple[int, ...]:
            if token.endswith(end):
                head = [letters[c] for c in token[:-len(end)]]
                return (*head[:-1], head[-1] + 256)
            return tuple(letters[c] for c in token)

        self.tokens = {symbols(t): n for t, n in model["vocab"].items()}
        self.spelled = {n: s for s, n in self.tokens.items()}
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[(self.tokens[symbols(left)], self.tokens[symbols(right)])] = (
                rank, self.tokens[symbols(left + right)])
        self.beginnings = {s[:n] for s in self.tokens for n in range(1, len(s))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """State 0: nothing read, a token may begin right here."""
        self.steps: dict[int, tuple[int, int]] = {}
        self.states: list[tuple] = [(((), -1, 0),)]
        self.numbers = {self.states[0]: 0}
        self.words: dict[bytes, int] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """Byte-pair merging of a short list of ids."""
        while len(ids) > 1:
            found = min(((self.ranks[p][0], n) for n, p in enumerate(zip(ids, ids[1:], strict=False))
                         if p in self.ranks), default=None)
            if found is None:
                break
            n = found[1]
            ids = [*ids[:n], self.ranks[(ids[n], ids[n + 1])][1], *ids[n + 2:]]
        return ids

    def stands(self, left: int, right: int) -> bool:
        """Whether two tokens keep their border when their letters are merged together."""
        key = (left, right)
        if key not in self.pairs:
            letters = [self.tokens[(s,)] for s in self.spelled[left] + self.spelled[right]]
            self.pairs[key] = self.merged(letters) == [left, right]
        return self.pairs[key]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """Make a transition: the next state and the tokens it emits.

        A state lists, longest first, each suffix a token may be growing on: its symbols, the last token before it (-1
        at the word's start) and the count before it relative to the count at the state.
        """
        for grown, last, count in self.states[state]:
            token = self.tokens.get((*grown, symbol))
            if token is not None and (last < 0 or self.stands(last, token)):
                emitted = count + 1
                break
        else:
            raise ValueError(f"no token for symbol {symbol}")
        live = [((*grown, symbol), last, count - emitted) for grown, last, count in self.states[state]
                if (*grown, symbol) in self.beginnings]
        live.append(((), token, 0))
        key = tuple(live)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
        made = self.steps[state << 9 | symbol] = (self.numbers[key], emitted)
        return made

    def run(self, word: bytes) -> int:
        """Tokens of one non-empty piece that the splitter leaves whole."""
        if len(self.steps) > TRANSITIONS:
            self.reset()
        state, total, known = 0, 0, self.steps.get
        for symbol in word[:-1]:
            state, emitted = known(state << 9 | symbol) or self.step(state, symbol)
            total += emitted
        symbol = word[-1] + 256
        return total + (known(state << 9 | symbol) or self.step(state, symbol))[1]

    def word(self, raw: bytes) -> int:
        """Tokens of a run without ASCII white space: special strings, normalisation, splitting, then the transducer."""
        text, total = raw.decode("utf-8", "replace"), 0
        if "<|" in text:
            total = len(self.special.findall(text))
            pieces = self.special.split(text)
        else:
            pieces = (text,)
        for piece in pieces:
            if not piece.isascii():
                # letter by letter: a final sigma is lowered like any other
                piece = "".join([c.lower() for c in unicodedata.normalize("NFC", piece)])
            for part in self.split(piece.lower() if piece.isascii() else piece):
                total += self.run(part.encode("utf-8"))
        return total

    def count(self, words: list[bytes]) -> int:
        """Tokens of whole words."""
        known = self.words
        try:
            return sum([known[w] for w in words])
        except KeyError:
            total = 0
            for w in words:
                n = known.get(w)
                if n is None:
                    n = self.word(w)
                    known = self.words
                    if len(w) <= WORD_LENGTH:
                        if len(known) >= WORDS:
                            known.clear()
                        known[w] = n
                total += n
            return total

    def chunk(self, text: bytes) -> tuple[bytes, int, bytes | None]:
        """State map of a chunk: head up to the first space, tokens between, tail after the last one (None: no space)."""
        words = text.split()
        if not words:
            return (b"", 0, b"") if text else (b"", 0, None)
        if len(words) == 1 and len(words[0]) == len(text):
            return text, 0, None
        head = b"" if text[:1].isspace() else words.pop(0)
        tail = b"" if text[-1:].isspace() or not words else words.pop()
        return head, self.count(words), tail

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two chunks in a row; associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + (self.count([a[2] + b[0]]) if a[2] or b[0] else 0) + b[1], b[2]

    def text(self, text: bytes) -> int:
        if len(text) <= CHUNK:
            return self.count(text.split())
        return self.finished(self.folded([self.chunk(text[at:at + CHUNK]) for at in range(0, len(text), CHUNK)]))

    def folded(self, maps: list[tuple]) -> tuple:
        """The map of several chunks in a row, folded as a balanced tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[n:n + 2]) if n + 1 < len(maps) else maps[n] for n in range(0, len(maps), 2)]
        return maps[0]

    def finished(self, whole: tuple) -> int:
        """Tokens of a text with this map."""
        head, total, tail = whole
        return total + self.count([w for w in (head, tail) if w])


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per Python worker, kept from task to task."""
    return Transducer(path)


def long_counts(docs: DataFrame, tokenizer: str, limit: int, chunk: int, fan: int) -> DataFrame | None:
    """The rows of ``token_counts`` for texts of several chunks, (row, doc_id, text); None if there are none.

    Chunks are dealt to tasks by row and place, so a text's chunks spread over all tasks. Each round groups ``fan``
    neighbouring maps; rounds follow the logarithm of the longest text.
    """
    def cut(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for rows in slices:
            for row, key, text in rows:
                raw = encoded(text)
                for start in range(0, len(raw), fan * chunk):
                    yield [(row, key, len(raw), at // chunk, raw[at:at + chunk])
                           for at in range(start, min(start + fan * chunk, len(raw)), chunk)]

    def mapped(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        machine = transducer(tokenizer)
        for rows in slices:
            yield [(*row[:4], *machine.chunk(row[4])) for row in rows]

    schema = arrow_schema(MAPS)

    def composed(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in table.select(schema.names).columns), strict=True), key=lambda r: r[3])
        whole = transducer(tokenizer).folded([row[4:] for row in rows])
        row = (*rows[0][:3], rows[0][3] // fan, *whole)
        return pa.Table.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

    def finished(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        machine = transducer(tokenizer)
        for rows in slices:
            counts = [machine.finished(row[4:]) for row in rows]
            yield [(row[1], row[2], n, n > limit) for row, n in zip(rows, counts, strict=True)]

    chunks = stored(map_rows(docs, cut, CHUNKS).repartition("row", "place"), "chunks")
    last = chunks.agg(F.max("place")).first()[0]
    if last is None:
        return None
    maps = map_rows(chunks, mapped, MAPS)
    while last > 0:
        maps = maps.groupBy("row", F.floor(F.col("place") / fan).alias("up")).applyInArrow(composed, MAPS)
        last //= fan
    return map_rows(maps, finished, COUNTS)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text",
                 chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Bytes and tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit; one row per row.

    ``tokenizer`` is a byte-level BPE file with word ends whose splitter drops white space. Texts of one ``chunk``
    are counted where they are read; chunks of longer ones are shuffled and their maps composed. A run without white space
    is one word however long, and stays whole. Null counts as empty: no bytes, no tokens. Repeated rows and null ids:
    counted each for itself. An empty table gives no rows. Other columns are ignored.
    """

    def run(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        machine = transducer(tokenizer)
        for rows in slices:
            out = []
            for key, value in rows:
                raw = encoded(value)
                n = machine.text(raw)
                out.append((key, len(raw), n, n > limit))
            yield out

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    counts = map_rows(rows.where(~is_long), run, COUNTS)
    # the number of a row only has to tell rows apart until its chunks are written
    numbered = rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    others = long_counts(numbered, tokenizer, limit, chunk, fan)
    return counts if others is None else counts.unionByName(others)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
