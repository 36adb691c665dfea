"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolboard.llm.common import map_rows, range_cuts, range_of, read_documents

#: A Mersenne prime, so that remainders take shifts and sums; two bases make two independent hashes.
PRIME = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
#: Code points of the spans that a fingerprint samples, and the bins it keeps the smallest span hash of.
WIDTH, BINS = 12, 128
EMPTY = 0xFFFF
U = np.uint64


def reduced(x: np.ndarray) -> np.ndarray:
    """Remainder by the prime of numbers below 2**62."""
    x = (x & U(PRIME)) + (x >> U(31))
    x = (x & U(PRIME)) + (x >> U(31))
    return np.where(x == U(PRIME), U(0), x)


class Powers:
    """Powers of a base and of its inverse, longer when a longer text comes."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate((self.up, reduced(self.up * U(pow(self.base, size, PRIME)))))
            self.down = np.concatenate((self.down, reduced(self.down * U(pow(self.inverse, size, PRIME)))))
        return self.up[:n], self.down[:n]


POWERS = [Powers(base) for base in BASES]


class PrefixHash:
    """Prefix sums of code point times power, modulo the prime: any span's hash in constant time.

    ``sums[k][n]`` covers the first n code points under base k. A span's hash is the difference of two sums, divided by
    the power at its start, so equal spans have equal hashes wherever they lie.
    """

    def __init__(self, length: int, sums: list[np.ndarray]) -> None:
        self.length, self.sums = length, sums

    @classmethod
    def of(cls, text: str) -> PrefixHash:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U) + U(1)
        sums = []
        for powers in POWERS:
            total = np.zeros(len(points) + 1, dtype=U)
            np.cumsum(reduced(points * powers.get(len(points))[0]), out=total[1:])
            sums.append(reduced(total))
        return cls(len(points), sums)

    def joined(self, keep: int, other: PrefixHash, add: int) -> PrefixHash:
        """The prefix hash of this text's first ``keep`` code points and the other's first ``add``, from the sums."""
        sums = []
        for powers, mine, theirs in zip(POWERS, self.sums, other.sums, strict=True):
            shift = powers.get(keep + 1)[0][keep]
            sums.append(np.concatenate((mine[:keep + 1], reduced(mine[keep] + reduced(theirs[1:add + 1] * shift)))))
        return PrefixHash(keep + add, sums)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Hash of a span under both bases."""
        return tuple((int(s[end]) - int(s[start])) * int(p.get(start + 1)[1][start]) % PRIME
                     for s, p in zip(self.sums, POWERS, strict=True))

    def common(self, start: int, other: PrefixHash, at: int) -> int:
        """Longest common extension of two places, by binary search over span equality."""
        low, high = 0, min(self.length - start, other.length - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start + low, start + middle) == other.span(at + low, at + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` code points (a shorter text: the whole), spread over 64 bits."""
        width = min(width, self.length)
        if not width:
            return np.zeros(0, dtype=U)
        n = self.length - width + 1
        sums = self.sums[0]
        hashes = reduced(reduced(sums[width:] + U(PRIME) - sums[:n]) * POWERS[0].get(n)[1])
        hashes *= U(0x9E3779B97F4A7C15)
        hashes ^= hashes >> U(29)
        hashes *= U(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> U(32)
        return hashes

    def sketch(self) -> np.ndarray:
        """16 bits of the smallest span hash in each bin, ``EMPTY`` for a bin without a span."""
        hashes = self.windows(WIDTH)
        out = np.full(BINS, EMPTY, dtype=np.uint16)
        if not len(hashes):
            return out
        few = hashes
        if len(hashes) > 64 * BINS:  # small hashes alone, if each bin has one
            few = hashes[(hashes & U(0xFFFFFFFF)) < U((1 << 32) * 32 * BINS // len(hashes))]
            if len(np.unique(few >> U(57))) < BINS:
                few = hashes
        ranked = np.sort((few >> U(57)) << U(32) | few & U(0xFFFFFFFF))
        bins = ranked >> U(32)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        out[bins[first].astype(np.int64)] = np.minimum(ranked[first] & U(0xFFFF), U(EMPTY - 1)).astype(np.uint16)
        return out

    def fingerprint(self) -> str:
        """Hexadecimal: length, both hashes of the whole text, then the sketch."""
        a, b = self.span(0, self.length)
        return f"{self.length:08x}{a:08x}{b:08x}" + self.sketch().astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal bins among those that either fingerprint fills; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[24:]), dtype=">u2") for f in (a, b))
    filled = (x != EMPTY) | (y != EMPTY)
    return float(((x == y) & filled).sum() / max(1, filled.sum()))


SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, edited_prefix bigint")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text: its last third replaced by the next document's beginning.

    The next document is the one before it by id (after the last: the first), so documents are needed in order.
    They are dealt once into ranges of ids and sorted inside each; the first document of a range also goes to the end
    of the range before it, a row per range. A task holds two documents at a time. The edited text's prefix hashes come
    from both texts' sums; ``edited_prefix`` is the longest common beginning of both texts by these hashes.

    Null counts as empty. Null ids come last, rows with equal ids are ordered by their text, repeated rows follow one
    another, and a single row is its own next. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = parts or max(docs.rdd.getNumPartitions(), 1)
    ids = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"))
    cuts = range_cuts(ids, "doc_id", parts)
    # descending: the null range last, then from the last range to the first
    turned = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(len(cuts) - range_of(cuts, "doc_id"))
    heads = sorted(ids.withColumn("part", turned).groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    schema = "head bigint, no_head boolean, tail_of int"
    after = [(head, head is None, heads[n - 1][0]) for n, (_, head) in enumerate(heads)]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(after, schema))  # a row per range
    tails = (rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("head")))
             .groupBy("tail_of", "doc_id").agg(F.min("text").alias("text"))
             .select(F.col("tail_of").alias("part"), "doc_id", "text", F.lit(1).alias("tail")))
    dealt = (rows.select(turned.cast("int").alias("part"), "doc_id", "text", F.lit(0).alias("tail"))
             .unionByName(tails).repartitionById(len(cuts) + 2, "part")
             .sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "text"))

    def run(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        held = None
        for chunk in slices:
            out = []
            for part, key, value, tail in chunk:
                own = PrefixHash.of(value)
                now = (part, key, value, own, own.fingerprint())
                if held is not None and held[0] == part:
                    out.append(pair(held, now))
                held = None if tail else now
            yield out

    def pair(a: tuple, b: tuple) -> tuple:
        _, key, value, own, print_ = a
        _, _, other, theirs, next_print = b
        cut = len(value) // 3
        add = min(cut, len(other))
        keep = len(value) - cut
        edited = own.joined(keep, theirs, add)
        edited_print = edited.fingerprint()
        digest = hashlib.sha256((value[:keep] + other[:add]).encode("utf-8", "surrogatepass")).hexdigest()
        return (key, len(value), digest, print_, edited_print, likeness(print_, edited_print),
                likeness(print_, next_print), own.common(0, edited, 0))

    return map_rows(dealt, run, SCHEMA)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(read_documents(spark, sf_dir))
