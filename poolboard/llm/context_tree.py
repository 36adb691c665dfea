"""Language-model scores by context-tree weighting over the bytes of texts.

A text is its lower-cased words, each closed by a space, and an end token (a line break, closed alike). A byte is eight
binary decisions. The context of a decision is the bits of its byte so far and the ``DEPTH`` bytes before it, latest
first, across words, back to the space before the text. Each context at each depth has a Krichevsky-Trofimov estimate of
its decision; context-tree weighting mixes the estimates of all depths by how well each subtree explains the training
text.

``score_whole_texts``: grams (``DEPTH`` context bytes and a symbol) are counted per slice of texts and merged, then
subtrees of the context tree grow per group of grams that agree in the last two bytes. Each slice then asks for its
distinct grams and adds their values up along its texts. ``score_texts`` ends contexts at the space before the word, so
that model is learned and applied per distinct word. Only the two top levels of the tree (at most 256 * 256 numbers) and
the words that make up at least ``HOT`` of the training text (at most 1 / HOT) are held by every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolboard.llm.common import (
    SLICE_BYTES, arrow_schema, batch_slices, filled_slices, give_back, lower_words, read_documents, stored,
)

#: Bytes of context; a gram's context and symbol fit into seven bytes of a long.
DEPTH = 6
#: Share of the training tokens from which a word is held by every task: at most 50,000 words.
HOT = 2e-5
#: Distinct words to a partition of the vocabulary.
PART_WORDS = 200_000
#: Bytes of texts whose grams are counted, and asked for, at once.
GRAM_BYTES = 8 << 20
#: Bytes of a slice whose grams are held at once, repeated ones too: eight bytes each.
PIECE_BYTES = 1 << 20
#: Grams whose subtree grows at once; a larger group is split by one more byte of context.
GROWN = 30_000
END, SPACE = "\n", 32
BITS = np.arange(8)


def log2_gamma(x: np.ndarray) -> np.ndarray:
    """log2 of the gamma function for x > 0, by Stirling's series after eight steps of the recurrence."""
    shift = np.zeros_like(x)
    for n in range(8):
        shift += np.log(x + n)
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    return (series - shift) / np.log(2)


def block_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log2 of the Krichevsky-Trofimov probability of sequences with these counts."""
    return log2_gamma(zeros + 0.5) + log2_gamma(ones + 0.5) - log2_gamma(zeros + ones + 1) - np.log2(np.pi)


def decisions(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight nodes (1 to 255: a one, then the bits so far) and bits of each symbol, highest bit first."""
    wide = symbols.astype(np.int64)[:, None]
    return 1 << BITS | wide >> (8 - BITS), wide >> (7 - BITS) & 1


def positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of the words (their closing spaces included), and the number of bytes of each word.

    A gram packs the context, latest byte highest, and the symbol: 1 + DEPTH bytes. Past the space before the word the
    context is zeros.
    """
    flat = np.frombuffer(b"\0" * DEPTH + b" " + b" ".join(words) + b" ", dtype=np.uint8)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    n = int(sizes.sum())
    first = DEPTH + 1
    grams = np.zeros(n, dtype=np.int64)
    alive = np.ones(n, dtype=bool)
    for back in range(1, DEPTH + 1):
        byte = flat[first - back:first - back + n] * alive
        grams |= byte.astype(np.int64) << (8 * (DEPTH + 1 - back))
        alive &= byte != SPACE
    return grams | flat[first:first + n], sizes


def closed_texts(lists: pa.ListArray) -> tuple[bytes, np.ndarray]:
    """The bytes of texts from their words, each text closed by its end token, and the number of bytes of each."""
    joined = pc.ascii_trim(pc.binary_join(lists.cast(pa.list_(pa.string())), " "), " ")
    whole = pc.if_else(pc.equal(joined, ""), END + " ", pc.binary_join_element_wise(joined, END + " ", " "))
    return b"".join(whole.cast(pa.binary()).to_pylist()), pc.binary_length(whole).to_numpy().astype(np.int64)


def text_grams(raw: bytes, sizes: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The gram of every byte of closed texts, or of those from ``first`` to before ``last``, packed as in ``positions``;
    contexts reach back to the space before the text, past it they are zeros."""
    last = len(raw) if last is None else min(last, len(raw))
    before = (b"\0" * DEPTH + b" " + raw[max(0, first - DEPTH - 1):first])[-DEPTH - 1:]
    flat = before + raw[first:last]
    grams = np.ndarray((last - first,), "<i8", flat, 0, (1,)).copy()  # seven bytes and, highest, the symbol
    grams &= 0xFFFFFFFFFFFF00
    grams |= np.frombuffer(flat, dtype=np.uint8, offset=DEPTH + 1)
    starts = np.cumsum(sizes) - sizes
    for k in range(DEPTH - 1):
        at = starts[sizes > k] + k - first
        grams[at[(at >= 0) & (at < len(grams))]] &= ~((1 << 8 * (DEPTH - k)) - 256)
    return grams


def gram_pieces(raw: bytes, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """``text_grams`` in pieces of ``PIECE_BYTES`` bytes."""
    return (text_grams(raw, sizes, at, at + PIECE_BYTES) for at in range(0, len(raw), PIECE_BYTES))


def run_starts(grams: np.ndarray) -> np.ndarray:
    """Where each of the sorted grams comes first."""
    fresh = np.empty(len(grams), dtype=bool)
    fresh[:1] = True
    np.not_equal(grams[1:], grams[:-1], out=fresh[1:])
    return np.flatnonzero(fresh)


def distinct_grams(pieces: Iterator[np.ndarray]) -> np.ndarray:
    """The grams of all pieces sorted, each once; pieces are sorted in place, only their distinct grams are kept."""
    found = []
    for grams in pieces:
        grams.sort()
        found.append(grams[run_starts(grams)])
        del grams
    whole = np.concatenate(found)
    found.clear()
    whole.sort()
    return whole[run_starts(whole)]


def counted_grams(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of closed texts sorted, each once, and how often each comes."""
    grams = text_grams(raw, sizes)
    grams.sort()
    first = run_starts(grams)
    return grams[first], np.diff(first, append=len(grams))


def homes(grams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted grams by their part, and where each part begins. The last four bytes of a gram's context
    give its part, so what a part gets of a slice is alike and compresses well."""
    home = ((grams >> 24) % 1_000_003 % parts).astype(np.int32)
    order = np.argsort(home, kind="stable")
    return order, np.searchsorted(home[order], np.arange(parts + 1))


def places_of(asked: np.ndarray, pieces: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Where each gram is in the sorted ``asked``, piece by piece: by a table of hashes, by search where hashes collide."""
    def slots(x: np.ndarray) -> np.ndarray:
        return x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)

    table = np.zeros(1 << 22, dtype=np.int32)
    table[slots(asked)] = np.arange(len(asked))
    for piece in pieces:
        at = table[slots(piece)]
        missed = np.flatnonzero(asked[at] != piece)
        at[missed] = np.searchsorted(asked, piece[missed])
        yield at


def packed(numbers: np.ndarray, kind: str = "<i8") -> bytes:
    """Numbers by bytes of the same weight, compressed: sorted grams, and exponents, have long runs there."""
    planes = np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind: str = "<i8") -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], width * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def subtree(grams: np.ndarray, counts: np.ndarray, top: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Below one context of ``top`` bytes: the weighted log2 probability per node, and each gram's mixed estimates.

    ``grams`` are sorted and distinct, with training counts (0: wanted only). The estimates are of the gram's own
    eight bits, mixed over the depths from ``top`` down; not a number where training has not reached the node at all.
    A context that training never reached has no say: its parent's estimate stands for it.
    """
    node, bit = decisions(grams & 0xFF)
    weights = np.repeat(counts.astype(np.float64), 8)
    flat_bit = bit.reshape(-1)
    levels = []
    for depth in range(top, DEPTH + 1):
        context = grams >> (8 * (DEPTH + 1 - depth))
        fresh = np.concatenate(([True], context[1:] != context[:-1]))
        number = np.cumsum(fresh) - 1
        ids, at = np.unique((number[:, None] * 256 + node).reshape(-1), return_inverse=True)
        total = np.bincount(at, weights, len(ids))
        ones = np.bincount(at, weights * flat_bit, len(ids))
        levels.append((ids, at, total, ones, number, np.flatnonzero(fresh), block_probability(total - ones, ones)))
    weighted = levels[-1][6]
    mixed = reached = None
    for depth in range(len(levels) - 1, -1, -1):
        ids, at, total, ones, number, _, estimate = levels[depth]
        hits = np.where(flat_bit == 1, ones[at], total[at] - ones[at])
        own = (hits + 0.5) / (total[at] + 1)
        if depth == len(levels) - 1:
            mixed = own
        else:
            below = levels[depth + 1]
            parent = number[below[5]][below[0] >> 8] * 256 + (below[0] & 0xFF)
            split = np.bincount(np.searchsorted(ids, parent), weighted, len(ids))
            weighted = np.logaddexp2(estimate, split) - 1
            stop = np.exp2(estimate - 1 - weighted)[at]
            mixed = np.where(reached, stop * own + (1 - stop) * mixed, own)
        reached = total[at] > 0
    out = np.zeros(256)
    out[levels[0][0] & 0xFF] = weighted
    return out, np.where(reached, mixed, np.nan).reshape(-1, 8)


def split_subtree(grams: np.ndarray, counts: np.ndarray, top: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """``subtree`` in bounded memory: above ``GROWN`` grams the contexts one byte longer grow one after the other."""
    if len(grams) <= GROWN or top == DEPTH:
        return subtree(grams, counts, top)
    context = grams >> (8 * (DEPTH - top))
    cuts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1], [True])))
    below, parts = np.zeros(256), []
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        weighted, mixed = split_subtree(grams[start:end], counts[start:end], top + 1)
        below += weighted
        parts.append(mixed.astype("<f4"))
    node, bit = decisions(np.arange(256))
    symbols = np.bincount(grams & 0xFF, counts, 256)
    total, ones = np.zeros(256), np.zeros(256)
    np.add.at(total, node, symbols[:, None])
    np.add.at(ones, node, symbols[:, None] * bit)
    estimate = block_probability(total - ones, ones)
    weighted = np.logaddexp2(estimate, below) - 1
    stop = np.exp2(estimate - 1 - weighted)
    one = (ones + 0.5) / (total + 1)
    for n, (start, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        at, bits = node[grams[start:end] & 0xFF], bit[grams[start:end] & 0xFF]
        own = np.where(bits == 1, one[at], 1 - one[at])
        mixed = np.where(np.isnan(parts[n]), own, stop[at] * own + (1 - stop[at]) * parts[n])
        parts[n] = np.where(total[at] > 0, mixed, np.nan).astype("<f4")
    here = np.unique(node[np.unique(grams & 0xFF)])
    out = np.zeros(256)
    out[here] = weighted[here]
    return out, np.concatenate(parts)


class Crown:
    """The two top levels of the tree: no context, and the last byte."""

    def __init__(self, symbol_counts: np.ndarray, below: np.ndarray) -> None:
        """``symbol_counts[c, s]``: training count of symbol s after byte c; ``below[c, node]``: log2 weighted
        probabilities of the contexts of two bytes, summed over the second."""
        node, bit = decisions(np.arange(256))
        self.total, self.ones = np.zeros((257, 256)), np.zeros((257, 256))
        counts = np.vstack((symbol_counts, symbol_counts.sum(axis=0)))  # row 256: no context
        for j in range(8):
            for s in range(256):
                self.total[:, node[s, j]] += counts[:, s]
                self.ones[:, node[s, j]] += counts[:, s] * bit[s, j]
        estimate = block_probability(self.total - self.ones, self.ones)
        one = np.logaddexp2(estimate[:256], below) - 1
        none = np.logaddexp2(estimate[256], one.sum(axis=0)) - 1
        self.stop = np.exp2(estimate - 1 - np.vstack((one, none)))

    def bits(self, grams: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """log2 probability of each gram's symbol in its context."""
        node, bit = decisions(grams & 0xFF)
        byte = (grams >> (8 * DEPTH))[:, None]
        for row in (byte, np.full_like(byte, 256)):
            total, ones = self.total[row, node], self.ones[row, node]
            own = (np.where(bit == 1, ones, total - ones) + 0.5) / (total + 1)
            stop = self.stop[row, node]
            mixed = np.where(np.isnan(mixed), own, stop * own + (1 - stop) * mixed)
            mixed = np.where(total > 0, mixed, np.nan)
        mixed = np.where(np.isnan(mixed), 0.5, mixed)  # nothing was ever learned
        return np.log2(mixed).sum(axis=1)


def vocabulary(docs: DataFrame) -> DataFrame:
    """Distinct tokens of all rows (held_out, text) with their count in the training rows: word, c."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches):
            for held in (False, True):
                texts = batch.column(1).filter(pc.equal(batch.column(0), held))
                counted = lower_words(texts).flatten().value_counts()
                words, counts = counted.field(0).to_numpy(zero_copy_only=False), counted.field(1).to_numpy()
                keep = words != ""
                words, counts = words[keep].tolist(), counts[keep] * (not held)
                if len(texts):
                    words, counts = [*words, END], np.append(counts, 0 if held else len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())],
                                                 ["word", "c"])

    return docs.select("held_out", "text").mapInArrow(count, "word string, c bigint").groupBy("word").agg(
        F.sum("c").alias("c"))


def gram_counts(vocab: DataFrame) -> DataFrame:
    """Distinct grams of all words with their training counts: gram, n."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches):
            words = [w.encode() for w in batch.column(0).to_pylist()]
            if words:
                grams, sizes = positions(words)
                weights = np.repeat(batch.column(1).to_numpy(), sizes)
                distinct, at = np.unique(grams, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct), pa.array(np.bincount(at, weights, len(distinct)).astype(np.int64))],
                    ["gram", "n"])

    return vocab.select("word", "c").mapInArrow(split, "gram bigint, n bigint").groupBy("gram").agg(
        F.sum("n").alias("n"))


def text_gram_counts(docs: DataFrame, parts: int) -> DataFrame:
    """Distinct grams of all texts of (held_out, text) with their counts in the training rows: gram, n.

    A slice of texts gives one row to each part of the grams; a part merges its rows.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filled_slices(batches, GRAM_BYTES):
            for held in (False, True):
                texts = batch.column(1).filter(pc.equal(batch.column(0), held))
                if not len(texts):
                    continue
                grams, counts = counted_grams(*closed_texts(lower_words(texts)))
                order, cuts = homes(grams, parts)
                grams, counts = grams[order], counts[order] * (not held)
                some = np.flatnonzero(cuts[1:] > cuts[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)),
                     pa.array([packed(grams[cuts[p]:cuts[p + 1]]) for p in some], pa.binary()),
                     pa.array([packed(counts[cuts[p]:cuts[p + 1]]) for p in some], pa.binary())],
                    ["home", "grams", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        grams = np.concatenate([unpacked(x.as_py()) for x in table.column("grams")])
        counts = np.concatenate([unpacked(x.as_py()) for x in table.column("counts")])
        order = np.argsort(grams)
        grams = grams[order]
        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        merged = pa.table({"gram": pa.array(grams[first]), "n": pa.array(np.add.reduceat(counts[order], first))})
        give_back()
        return merged

    return docs.select("held_out", "text").mapInArrow(split, "home int, grams binary, counts binary").groupBy(
        "home").applyInArrow(merge, "gram bigint, n bigint")


def grown(grams: DataFrame) -> DataFrame:
    """Estimates of each gram (32 bytes: eight floats), and for each two-byte context -1 - context with 256 doubles."""

    def grow(table: pa.Table) -> pa.Table:
        keys = table.column("gram").to_numpy()
        order = np.argsort(keys)
        keys = keys[order]
        weighted, mixed = split_subtree(keys, table.column("n").to_numpy()[order])
        raw = pa.py_buffer(np.ascontiguousarray(mixed, dtype="<f4").tobytes())
        rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(keys), [None, raw]).cast(pa.binary())
        top = pa.array([weighted.astype("<f8").tobytes()], pa.binary())
        gram = np.append(keys, -1 - (keys[0] >> (8 * (DEPTH - 1))))
        return pa.table({"gram": pa.array(gram), "estimates": pa.chunked_array([rows, top])})

    pair = F.shiftright("gram", 8 * (DEPTH - 1))
    return grams.withColumn("pair", pair).groupBy("pair").applyInArrow(grow, "gram bigint, estimates binary")


def crown(grams: DataFrame, trees: DataFrame) -> Crown:
    """The top of the tree from sums of at most 256 * 256 rows."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype="<f8") for x in table.column("estimates"))
        return pa.table({"byte": table.column("byte").slice(0, 1), "below": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((256, 256))
    by_symbol = grams.groupBy(F.shiftright("gram", 8 * DEPTH).alias("byte"), (F.col("gram") % 256).alias("symbol"))
    for byte, symbol, n in by_symbol.agg(F.sum("n")).collect():
        counts[byte, symbol] = n
    below = np.zeros((256, 256))
    tops = trees.where("gram < 0").withColumn("byte", F.shiftright(-1 - F.col("gram"), 8)).select("byte", "estimates")
    for byte, values in tops.groupBy("byte").applyInArrow(add, "byte bigint, below binary").collect():
        below[byte] = np.frombuffer(values, dtype="<f8")
    return Crown(counts, below)


def word_hash(word: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(word), "big", signed=True)


def word_scores(vocab: DataFrame, trees: DataFrame, top: Crown, parts: int) -> DataFrame:
    """Hash, training count and log10 probability of every distinct word: h, c, score.

    A part of the vocabulary asks each part of the grams for its distinct grams, gets their log2 probabilities back and
    adds them up by word.
    """
    vocab = vocab.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        grams, _ = positions([w.encode() for w in table.column("word").to_pylist()])
        grams = np.unique(grams)
        home = grams % 1_000_003 % parts
        order = np.argsort(home, kind="stable")
        grams, home = grams[order], home[order]
        cuts = np.searchsorted(home, np.arange(parts + 1))
        asked = [n for n in range(parts) if cuts[n] < cuts[n + 1]]
        return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(asked), pa.int32()),
                         "home": pa.array(asked, pa.int32()),
                         "grams": pa.array([grams[cuts[n]:cuts[n + 1]].tobytes() for n in asked], pa.binary())})

    def answer(grams: pa.Table, asked: pa.Table) -> pa.Table:
        keys = grams.column("gram").to_numpy()
        mixed = np.frombuffer(b"".join(grams.column("estimates").to_pylist()), dtype="<f4").reshape(-1, 8)
        order = np.argsort(keys)
        keys, values = keys[order], top.bits(keys[order], mixed[order].astype(np.float64))
        found = [values[np.searchsorted(keys, np.frombuffer(x.as_py(), dtype=np.int64))].tobytes()
                 for x in asked.column("grams")]
        return pa.table({"part": asked.column("part"), "grams": asked.column("grams"),
                         "values": pa.array(found, pa.binary())})

    def add(words: pa.Table, answers: pa.Table) -> pa.Table:
        grams = np.frombuffer(b"".join(answers.column("grams").to_pylist()), dtype=np.int64)
        values = np.frombuffer(b"".join(answers.column("values").to_pylist()), dtype="<f8")
        order = np.argsort(grams)
        grams, values = grams[order], values[order]
        raw = [w.encode() for w in words.column("word").to_pylist()]
        wanted, sizes = positions(raw)
        starts = np.cumsum(sizes) - sizes
        total = np.add.reduceat(values[np.searchsorted(grams, wanted)], starts) * np.log10(2)
        return pa.table({"h": pa.array([word_hash(w) for w in raw], pa.int64()),
                         "c": words.column("c"), "score": pa.array(total)})

    asked = vocab.select("part", "word").groupBy("part").applyInArrow(ask, "part int, home int, grams binary")
    held = trees.where("gram >= 0").withColumn("home", (F.col("gram") % 1_000_003 % parts).cast("int"))
    answers = held.groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(
        answer, "part int, grams binary, values binary")
    return vocab.select("part", "word", "c").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        add, "h bigint, c bigint, score double")


def word_counts(vocab: DataFrame) -> DataFrame:
    """Hash and training count of every distinct word, without a score: h, c, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches):
            hashes = [word_hash(w.encode()) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column(1),
                                              pa.array(np.zeros(len(hashes)))], ["h", "c", "score"])

    return vocab.select("word", "c").mapInArrow(run, "h bigint, c bigint, score double")


PIECE = ("home bigint, slice string, doc_ids array<bigint>, held array<boolean>, at binary, words binary, sums binary, "
         "texts binary, grams binary")
RESULT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
          "score double, bits_per_byte double")


def document_scores(docs: DataFrame, scored: DataFrame, tokens: int, distinct: int, parts: int,
                    trees: DataFrame | None = None, top: Crown | None = None) -> DataFrame:
    """Sums over each row's tokens. Hot words are added up where the text is; the others are asked for by hash.

    With ``trees`` and ``top`` the score is the sum over the grams of the row's whole text: a slice asks for its distinct
    grams, in order of their parts, and gets their log2 probabilities in the same order.
    """
    hot = np.array(scored.where(F.col("c") >= max(1, tokens * HOT)).orderBy("h").collect(),
                   dtype=[("h", "i8"), ("c", "i8"), ("score", "f8")]) if tokens else np.zeros(
        0, dtype=[("h", "i8"), ("c", "i8"), ("score", "f8")])
    slots, whole = tokens + distinct + 1, trees is not None

    def values(c: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Known, base score, score."""
        return np.stack((c > 0, np.log10((c + 1) / slots), score)).astype(np.float64)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        schema = arrow_schema_of
        for batch in filled_slices(batches, GRAM_BYTES) if whole else batch_slices(batches, SLICE_BYTES):
            if not batch.num_rows:
                continue
            name, n = f"{task}-{n}", n + 1
            lists = lower_words(batch.column(2))
            coded = lists.flatten().dictionary_encode()
            distinct_words = coded.dictionary.to_pylist()
            hashes = np.array([word_hash(w.encode()) for w in distinct_words], dtype=np.int64)
            empty = np.array([not w for w in distinct_words], dtype=bool)
            place = np.minimum(np.searchsorted(hot["h"], hashes), max(0, len(hot) - 1))
            is_hot = (hot["h"][place] == hashes if len(hot) else np.zeros(len(hashes), dtype=bool)) & ~empty
            code = coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            sums = np.zeros((5, batch.num_rows))  # known, base, score, tokens, bytes of the closed words
            live = ~empty[code]
            sums[3] = np.bincount(row[live], minlength=batch.num_rows) + 1
            lengths = np.fromiter((len(w.encode()) + 1 for w in distinct_words), np.int64, len(distinct_words))
            sums[4] = np.bincount(row[live], lengths[code[live]], batch.num_rows) + len(END) + 1
            chosen = is_hot[code]
            if chosen.any():
                own = values(hot["c"], hot["score"])[:, place[code[chosen]]]
                for k in range(3):
                    sums[k] = np.bincount(row[chosen], own[k], batch.num_rows)
            ask = live & ~chosen
            wanted, at = hashes[code[ask]], row[ask]
            # the end token of every row; it is asked for once and counted for all
            end = word_hash(END.encode())
            wanted, at = np.append(wanted, end), np.append(at, batch.num_rows)
            home = (wanted.view(np.uint64) >> np.uint64(1)) % np.uint64(parts)
            order = np.argsort(home, kind="stable")
            wanted, at, home = wanted[order], at[order].astype("<u4"), home[order]
            cuts = np.searchsorted(home, np.arange(parts + 1, dtype=np.uint64))
            out = [{"home": parts + task, "slice": name, "doc_ids": batch.column(0).to_pylist(),
                    "held": batch.column(1).to_pylist(), "at": None, "words": None, "sums": sums.tobytes()}]
            out += [{"home": p, "slice": name, "doc_ids": None, "held": None, "sums": None,
                     "at": at[cuts[p]:cuts[p + 1]].tobytes(), "words": wanted[cuts[p]:cuts[p + 1]].tobytes()}
                    for p in range(parts) if cuts[p] < cuts[p + 1]]
            if whole:
                raw, sizes = closed_texts(lists)
                out[0]["texts"] = pa.Codec("zstd", compression_level=7).compress(raw, asbytes=True)
                del lists, coded, distinct_words, hashes, code, row, live, chosen, ask, wanted, at
                grams = distinct_grams(gram_pieces(raw, sizes))
                order, cuts = homes(grams, parts)
                out += [{"home": p, "slice": name, "grams": packed(grams[order[cuts[p]:cuts[p + 1]]])}
                        for p in range(parts) if cuts[p] < cuts[p + 1]]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    arrow_schema_of = arrow_schema(PIECE)

    def answer(pieces: pa.Table, words: pa.Table) -> pa.Table:
        if whole:
            held = words.filter(pc.is_valid(words.column("estimates")))
            words = words.filter(pc.is_null(words.column("estimates")))
            keys = held.column("h").to_numpy()
            order = np.argsort(keys)
            keys = keys[order]
            raw = held.column("estimates").combine_chunks().cast(pa.binary(32))
            mixed = np.frombuffer(raw.buffers()[1], dtype="<f4").reshape(-1, 8)[raw.offset + order]
            found = [top.bits(keys[k:k + GROWN], mixed[k:k + GROWN].astype(np.float64))
                     for k in range(0, len(keys), GROWN)]
            gram_values = np.concatenate([*found, np.zeros(0)]).astype("<f4")
        h = words.column("h").to_numpy()
        order = np.argsort(h)
        h = h[order]
        known = values(words.column("c").to_numpy()[order], words.column("score").to_numpy()[order])
        out = []
        for piece in pieces.to_pylist():
            if piece["words"] is not None:
                found = known[:, np.searchsorted(h, np.frombuffer(piece["words"], dtype=np.int64))]
                rows, at = np.unique(np.frombuffer(piece["at"], dtype="<u4"), return_inverse=True)
                sums = np.stack([np.bincount(at, f, len(rows)) for f in found])
                piece |= {"at": rows.astype("<u4").tobytes(), "words": None, "sums": sums.tobytes()}
            if piece["grams"] is not None:
                piece["grams"] = packed(gram_values[np.searchsorted(keys, unpacked(piece["grams"]))], "<f4")
            out.append(piece)
        answers = pa.Table.from_pylist(out, schema=arrow_schema_of)
        if whole:
            give_back()
        return answers

    result = arrow_schema(RESULT)

    def finish(pieces: pa.Table) -> pa.Table:
        rows = pieces.to_pylist()
        home = next(r for r in rows if r["doc_ids"] is not None)
        n = len(home["doc_ids"])
        sums = np.frombuffer(home["sums"]).reshape(5, n).copy()
        ends = np.zeros(3)
        for r in sorted((r for r in rows if r["words"] is None and r["at"] is not None), key=lambda r: r["home"]):
            at = np.frombuffer(r["at"], dtype="<u4")
            more = np.frombuffer(r["sums"]).reshape(3, len(at))
            mine = at < n
            sums[:3, at[mine]] += more[:, mine]
            ends += more[:, ~mine].sum(axis=1)
        known, base, score = sums[:3] + ends[:, None]
        if whole:
            sizes = np.rint(sums[4]).astype(np.int64)
            raw = pa.decompress(home["texts"], int(sizes.sum()), codec="zstd", asbytes=True)
            asked = distinct_grams(gram_pieces(raw, sizes))
            order, _ = homes(asked, parts)
            found = np.empty(len(asked), dtype="<f4")
            found[order] = np.concatenate([unpacked(r["grams"], "<f4") for r in sorted(
                (r for r in rows if r["grams"] is not None), key=lambda r: r["home"])])
            along = np.concatenate([found[at] for at in places_of(asked, gram_pieces(raw, sizes))])
            score = np.add.reduceat(along, np.cumsum(sizes) - sizes, dtype=np.float64) * np.log10(2)
            give_back()
        return pa.Table.from_arrays([
            pa.array(home["doc_ids"], pa.int64()), pa.array(home["held"], pa.bool_()),
            pa.array(sums[3].astype(np.int64)), pa.array(np.rint(known).astype(np.int64)),
            pa.array(np.full(n, tokens, dtype=np.int64)), pa.array(base), pa.array(score),
            pa.array(-score / np.log10(2) / sums[4])], schema=result)

    pieces = docs.select("doc_id", "held_out", "text").mapInArrow(split, PIECE)
    places = scored.withColumn("home", F.shiftrightunsigned("h", 1) % parts)
    if whole:
        held = trees.where("gram >= 0").select(F.col("gram").alias("h"), "estimates",
                                               (F.shiftright("gram", 24) % 1_000_003 % parts).alias("home"))
        places = places.unionByName(held, allowMissingColumns=True)
    answered = pieces.groupBy("home").cogroup(places.groupBy("home")).applyInArrow(answer, PIECE)
    return answered.groupBy("slice").applyInArrow(finish, RESULT)


def rows_and_words(docs: DataFrame, held_out: str, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, tuple, int]:
    """The rows (doc_id, text, held_out), their vocabulary, its training tokens, known words and words, and the parts."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn(
        "held_out", F.expr(held_out))
    vocab = stored(vocabulary(rows), "vocabulary")
    tokens, distinct, words = vocab.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count("*")).first()
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows, vocab, (tokens or 0, distinct, words), max(shuffles, words // PART_WORDS + 1)


def score_texts(docs: DataFrame, held_out: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every text, with contexts within words.

    ``held_out`` is an SQL condition on ``doc_id``: rows that meet it are scored and not learned from. ``base_score``
    is the add-one unigram score; ``score`` is the context tree's log10 probability of the text; ``bits_per_byte`` its
    code length per byte of closed words. Word counts, grams and word scores are written to the shared folder.

    Null counts as empty: the end token alone. Repeated rows and null ids: scored each for itself. If nothing is held
    back for training every decision has probability one half. An empty table gives no rows.
    """
    rows, vocab, (tokens, distinct, _), parts = rows_and_words(docs, held_out, doc_id, text)
    grams = stored(gram_counts(vocab), "grams")
    trees = stored(grown(grams), "context-trees")
    scored = stored(word_scores(vocab, trees, crown(grams, trees), parts), "word-scores")
    return document_scores(rows, scored, tokens, distinct, parts)


def score_whole_texts(docs: DataFrame, held_out: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns and rows of ``score_texts``, with contexts that reach across words: their order counts.

    Every byte of every text is counted and scored in its ``DEPTH`` bytes of context. Word counts, grams, trees and the
    result are written to the shared folder, so that the Arrow batches of all stages are bounded.
    """
    rows, vocab, (tokens, distinct, _), parts = rows_and_words(docs, held_out, doc_id, text)
    grams = stored(text_gram_counts(rows, parts), "grams")
    trees = stored(grown(grams), "context-trees")
    counted = stored(word_counts(vocab), "word-counts")
    return stored(document_scores(rows, counted, tokens, distinct, parts, trees, crown(grams, trees)), "scores")


#: Rows of the registered query that are not learned from.
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 7 = 2, crc32(cast('' as binary)) % 7 = 2)"


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    return score_whole_texts(read_documents(spark, sf_dir), HELD_OUT)
