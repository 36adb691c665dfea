"""Exact near-duplicate groups: documents whose word shingle sets have a Jaccard similarity of a bound or more.

Equal sets are one node from the start. Sets are joined over the shingles of their prefixes (rare ones first): linked
sets share one. The index list of a shingle is sorted by set size; sizes and positions rule out most of a list, whole
blocks of it at once. Answers are reused between sets:

1. Each run of similar sizes in a list has a leader in its middle. All members are compared with their leader and with
   their neighbour (in short lists with all), a number of pairs that is linear in the lists. The links found are joined
   to components.
2. Members of one component need no further answer. For the others the answers of the leader are used: set differences
   obey the triangle inequality, so the differences of two sets from their leader bound the difference between them, from
   below and above; so do their parities. What neither this nor sizes nor positions decide is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolboard.llm.common import (
    arrow_schema, batch_slices, in_filter, key_filter, lower_words, may_be_in, read_documents, stored, whole_row,
)
from poolboard.llm.components import components

#: Shingles that come last in prefixes: the most frequent ones, at most this many (a matter of speed alone).
FREQUENT = 1 << 17
#: Times a shingle must occur in a slice of documents to be counted as a frequent one.
OFTEN = 4
#: Lists up to this length are compared in full in the first round.
SHORT = 6
#: Entries of an index list that are skipped together.
BLOCK = 64
#: Pairs a task remembers so as not to propose them again.
REMEMBERED = 200_000
U = np.uint64


def needed(n, m, percent: int):
    """Smallest intersection of sets of n and m that reaches the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n + percent * n // -100 + 1


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one shingle."""
    lists = lower_words(texts)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], dtype=U)
    code = coded.indices.to_numpy(zero_copy_only=False)
    live = np.array([bool(w) for w in words], dtype=bool)[code] if words else np.zeros(0, dtype=bool)
    ends = np.concatenate(([0], np.cumsum(live)))[lists.offsets.to_numpy()]
    flat = hashes[code[live]] if words else np.zeros(0, dtype=U)

    def folded(parts: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(parts[0]), len(parts), dtype=U)
        for part in parts:
            total = total * U(0x9E3779B97F4A7C15) + part
        return spread(total)

    n = len(flat) - width + 1
    grams = folded([flat[k:k + n] for k in range(width)]) if n > 0 else flat
    out = []
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if end - start >= width:
            out.append(np.unique(grams[start:end - width + 1]))
        elif end > start:
            out.append(folded([flat[k:k + 1] for k in range(start, end)]))
        else:
            out.append(flat[:0])
    return out


def signature(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each value of the hash's low bits: whether an odd number of shingles has it. About a bit a shingle."""
    bits = 1 << max(6, (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference: every bit that differs takes a shingle of one set alone."""
    x, y = sorted((np.frombuffer(p, dtype=np.uint8) for p in (a, b)), key=len)
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)  # the longer one, as if made with fewer bits
    return int(np.bitwise_count(x ^ folded).sum())


SETS = "doc_id bigint, n_shingles bigint, node binary, parity binary, shingle bigint, often bigint"
LISTS = "shingle bigint, node binary, n int, place int, leader binary, a binary, b binary"


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """A row per document (doc_id, n_shingles, node, parity), and rows (shingle, often) of shingles frequent in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches):
            sets = shingle_sets(batch.column(1), width)
            seen, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, U),) * 2
            seen, counts = seen[counts >= OFTEN].astype(np.int64, copy=False).view(np.int64), counts[counts >= OFTEN]
            none = [None] * len(seen)
            yield pa.RecordBatch.from_arrays([
                pa.array(batch.column(0).to_pylist() + none, pa.int64()),
                pa.array([len(s) for s in sets] + none, pa.int64()),
                pa.array([signature(s) for s in sets] + none, pa.binary()),
                pa.array([parity(s) for s in sets] + none, pa.binary()),
                pa.array([None] * len(sets) + seen.tolist(), pa.int64()),
                pa.array([None] * len(sets) + counts.tolist(), pa.int64())], schema=schema)

    schema = arrow_schema(SETS)
    return docs.mapInArrow(run, SETS)


def postings(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Prefix entries of each set, once per task: shingle, node, n, place (in the prefix)."""
    names = np.sort(frequent)
    ranks = np.argsort(frequent)  # frequent has the most frequent first
    schema = arrow_schema("shingle bigint, node binary, n int, place int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set()
        for batch in batch_slices(batches):
            out, nodes, sizes = [], [], []
            for shingles in shingle_sets(batch.column(0), width):
                n = len(shingles)
                node = signature(shingles)
                if not n or node in known:
                    continue
                known.add(node)
                length = prefix_length(n, percent)
                at = np.searchsorted(names, shingles) if len(names) else np.zeros(n, dtype=np.int64)
                late = names[np.minimum(at, len(names) - 1)] == shingles if len(names) else np.zeros(n, dtype=bool)
                chosen = shingles[~late][:length]
                if len(chosen) < length:
                    tail = shingles[late]
                    order = np.argsort(-ranks[at[late]], kind="stable")
                    chosen = np.concatenate((chosen, tail[order][:length - len(chosen)]))
                out.append(chosen)
                nodes.append(node)
                sizes.append(n)
            if out:
                lengths = [len(x) for x in out]
                place = np.concatenate([np.arange(x) for x in lengths])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(out).view(np.int64)),
                    pa.array(np.repeat(np.array(nodes, dtype=object), lengths), pa.binary()),
                    pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths)),
                    pa.array(place.astype(np.int32))], schema=schema)

    return docs.mapInArrow(run, "shingle bigint, node binary, n int, place int")


def index_lists(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    """The lists of two or more different nodes, as columns, from rows sorted by shingle, size and node."""
    held: list[list] = [[] for _ in range(columns)]

    def finished(rows: list[list]) -> list[list] | None:
        if len(rows[0]) < 2:
            return None
        keep = [k for k, node in enumerate(rows[1]) if not k or node != rows[1][k - 1]]
        if len(keep) < 2:
            return None
        return rows if len(keep) == len(rows[0]) else [[c[k] for k in keep] for c in rows]

    for batch in batches:
        shingles = batch.column(0).to_numpy()
        if not len(shingles):
            continue
        cuts = np.flatnonzero(shingles[1:] != shingles[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(shingles)]))
        first = True
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            last = end == len(shingles)
            if not first and not last and end - start < 2:
                continue
            rows = [c.slice(start, end - start).to_pylist() for c in batch.columns]
            if first and held[0] and held[0][0] == rows[0][0]:
                rows = [a + b for a, b in zip(held, rows, strict=True)]
            elif first and held[0] and (done := finished(held)):
                yield done
            first = False
            if last:
                held = rows
            elif done := finished(rows):
                yield done
    if held[0] and (done := finished(held)):
        yield done


def may_link(n: int, i: int, m: int, j: int, percent: int) -> bool:
    """Whether sets of n and m with their first common shingle at places i and j can reach the similarity."""
    return 100 * min(n, m) >= percent * max(n, m) and 1 + min(n - i - 1, m - j - 1) >= needed(n, m, percent)


def window_most(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The largest of ``values[start:end]`` for each start and end; -1 for an empty window."""
    out = np.full(len(starts), -1, dtype=np.int64)
    level = np.frexp(np.maximum(ends - starts, 0))[1] - 1
    most, width = values, 1  # most[k]: the largest of values[k:k + width]
    for k in range(int(level.max(initial=-1)) + 1):
        asked = np.flatnonzero(level == k)
        out[asked] = np.maximum(most[starts[asked]], most[ends[asked] - width])
        if 2 * width <= len(values):
            most, width = np.maximum(most[:-width], most[width:]), 2 * width
    return out


def with_partner(sizes: list[int], places: list[int], percent: int) -> np.ndarray:
    """The entries of a list sorted by size that ``may_link`` pairs with another entry, as indices."""
    n = np.array(sizes, dtype=np.int64)
    most = (100 + percent) * (n - np.array(places)) // percent - n  # the largest partner that its place leaves possible
    low = np.searchsorted(n, -(-percent * n // 100))
    high = np.searchsorted(n, np.minimum(100 * n // percent, most), "right")
    own = np.arange(len(n))
    best = window_most(most, np.concatenate((low, np.maximum(low, own + 1))), np.concatenate((np.minimum(high, own), high)))
    return np.flatnonzero(np.maximum(best[:len(n)], best[len(n):]) >= n)


def leaders(sizes: list[int], percent: int) -> list[int]:
    """For each entry of a list sorted by size the entry in the middle of its run of similar sizes."""
    out, start = [], 0
    for end in range(1, len(sizes) + 1):
        if end == len(sizes) or 100 * sizes[start] < percent * sizes[end]:
            out += [start + (end - start) // 2] * (end - start)
            start = end
    return out


def ordered(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    return (a, b) if a < b else (b, a)


def first_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """The longer lists with leaders, and the pairs of round one (only a and b set)."""
    schema = arrow_schema(LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        known: set[tuple] = set()
        for rows in index_lists(batches, 4):
            if len(rows[0]) > SHORT:  # an entry that no other one can link with needs no further look
                keep = with_partner(rows[2], rows[3], percent).tolist()
                rows = rows if len(keep) == len(rows[0]) else [[c[k] for k in keep] for c in rows]
            shingles, nodes, sizes, places = rows
            heads = leaders(sizes, percent)
            short = len(nodes) <= SHORT
            for k, head in enumerate(heads):
                if short:
                    others = range(k + 1, len(nodes))
                else:
                    out.append((shingles[k], nodes[k], sizes[k], places[k], nodes[head], None, None))
                    others = {head, k + 1 if k + 1 < len(heads) and heads[k + 1] == head else k}
                for other in others:
                    if other != k and may_link(sizes[k], places[k], sizes[other], places[other], percent):
                        pair = ordered(nodes[k], nodes[other])
                        if pair not in known:
                            known.add(pair)
                            out.append((None, None, None, None, None, *pair))
            if len(known) > REMEMBERED:
                known.clear()
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return entries.repartition("shingle").sortWithinPartitions("shingle", "n", "node").mapInArrow(run, LISTS)


def open_pairs(sizes: list[int], places: list[int], parts: list[bytes], heads: list[bytes], apart: list[int | None],
               parities: list[bytes], percent: int) -> Iterator[tuple[int, int, bool]]:
    """Pairs of a list that are still open, as indices: different components, not ruled out; True: known to link.

    A list is sorted by size. Each entry outside the largest component looks at the sizes that can link; blocks of it
    whose smallest place and largest size can't reach the needed intersection are skipped whole.
    """
    number = {part: k for k, part in enumerate(dict.fromkeys(parts))}
    if len(number) < 2:
        return
    n, at = np.array(sizes, dtype=np.int64), np.array(places, dtype=np.int64)
    part = np.array([number[p] for p in parts])
    head_number = {head: k for k, head in enumerate(dict.fromkeys(heads))}
    head = np.array([head_number[h] for h in heads])
    far = np.array([-1 if d is None else d for d in apart], dtype=np.int64)
    largest = np.bincount(part).argmax()
    starts = np.arange(0, len(n), BLOCK)
    room = np.maximum.reduceat(n - at, starts)
    least = np.minimum.reduceat(n, starts)
    for x in np.flatnonzero(part != largest).tolist():
        low, high = np.searchsorted(n, -(-percent * n[x] // 100)), np.searchsorted(n, 100 * n[x] // percent, "right")
        blocks = np.arange(low // BLOCK, -(-high // BLOCK))
        blocks = blocks[np.minimum(room[blocks], n[x] - at[x]) >= needed(n[x], np.maximum(least[blocks], n[low]), percent)]
        if not len(blocks):
            continue
        y = (blocks[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
        y = y[(y >= low) & (y < high)]
        y = y[(part[y] != part[x]) & ((part[y] == largest) | (y > x))]
        need = needed(n[x], n[y], percent)
        y, need = (z[np.minimum(n[x] - at[x], n[y] - at[y]) >= need] for z in (y, need))
        known = (head[y] == head[x]) & (far[y] >= 0) & (far[x] >= 0)
        most = (n[x] + n[y] - np.abs(far[y] - far[x])) // 2
        surely = known & ((n[x] + n[y] - far[y] - far[x]) // 2 >= need)
        keep = ~known | (most >= need)
        for other, sure, enough in zip(y[keep].tolist(), surely[keep].tolist(), need[keep].tolist(), strict=True):
            if sure or least_apart(parities[x], parities[other]) <= sizes[x] + sizes[other] - 2 * enough:
                yield x, other, sure


def second_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Round two: a, b, sure (whether they are known to link)."""
    schema = arrow_schema("a binary, b binary, sure boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        known: set[tuple] = set()
        for _, nodes, sizes, places, heads, parts, apart, parities in index_lists(batches, 8):
            for x, y, sure in open_pairs(sizes, places, parts, heads, apart, parities, percent):
                pair = ordered(nodes[x], nodes[y])
                if pair not in known:
                    known.add(pair)
                    out.append((*pair, sure))
            if len(known) > REMEMBERED:
                known.clear()
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = lists.select("shingle", "node", "n", "place", "leader", "component", "apart", "parity")
    return rows.repartition("shingle").sortWithinPartitions("shingle", "n", "node").mapInArrow(
        run, "a binary, b binary, sure boolean")


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parities leave the similarity possible: a, b. Chance meetings end here, without their sets."""
    schema = arrow_schema("a binary, b binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches):
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            keep = [k for k in range(len(a))
                    if least_apart(x[k], y[k]) <= n[k] + m[k] - 2 * needed(n[k], m[k], percent)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[k] for k in keep], pa.binary()) for c in (a, b)], schema=schema)

    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n"), F.col("parity").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("m"), F.col("parity").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y")
    return joined.mapInArrow(run, "a binary, b binary")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact answers of distinct pairs: a, b, apart (size of the symmetric difference), linked."""
    schema = arrow_schema("a binary, b binary, apart bigint, linked boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches):
            apart, linked = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                common = len(np.intersect1d(p, q, assume_unique=True))
                apart.append(len(p) + len(q) - 2 * common)
                linked.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(apart, pa.int64()), pa.array(linked)], schema=schema)

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a binary, b binary, apart bigint, linked boolean")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles (size of its set), component_id (smallest id reachable by links).

    Words are runs without ASCII white space, A-Z in lower case; a set holds the distinct shingles of ``width`` words. Two
    documents link when 100 * intersection >= ``percent`` * union. Null and empty texts have no shingles and link with
    nothing. Repeated rows are equal sets, so they share a component. A null id takes part like any other, but is the
    smallest id of no component: without another id the component is null. An empty table gives no rows.

    Shingles are 64-bit hashes, sets 128-bit ones. Four passes over the texts: sets, prefixes, and once a round the
    sets of documents in pairs that their parities can't rule out (an id filter of fixed size picks them, an exact join
    follows).
    """
    return _grouped(docs, width, percent, doc_id, text).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """``near_groups`` with the signatures of each row's set (``node``) and component; null for rows without shingles."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = stored(set_rows(rows, width), "sets")
    frequent = (found.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("often").alias("often"))
                .orderBy(F.desc("often"), "shingle").limit(FREQUENT).select("shingle").collect())
    late = np.array([r[0] for r in frequent], dtype=np.int64).view(U)
    own = found.where("shingle IS NULL")
    nodes = own.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("parity").alias("parity"))
    nodes = stored(nodes, "nodes")

    lists = stored(first_pairs(postings(rows.select("text"), width, percent, late), percent), "lists")
    entries = lists.where("shingle IS NOT NULL").drop("a", "b")
    asked = lists.where("a IS NOT NULL").select("a", "b").distinct()
    left = stored(possible(asked, nodes, percent), "possible-pairs")
    first = answers(rows, left, nodes, width, percent)
    links = first.where("linked").select("a", "b")
    parts = components(links)
    known = nodes.join(parts, "node", "left").select(
        "node", "parity", F.coalesce("component", "node").alias("component"))
    # parities come last: they are the longest column
    marked = (entries.withColumn("x", F.least("node", "leader")).withColumn("y", F.greatest("node", "leader"))
              .join(first.select(F.col("a").alias("x"), F.col("b").alias("y"), "apart"), ["x", "y"], "left").drop("x", "y")
              .withColumn("apart", F.when(F.col("node") == F.col("leader"), F.lit(0)).otherwise(F.col("apart")))
              .join(known, "node"))
    more = second_pairs(marked, percent).groupBy("a", "b").agg(F.max("sure").alias("sure"))
    more = stored(more.join(asked, ["a", "b"], "left_anti"), "open-pairs")
    second = answers(rows, more.where("NOT sure"), nodes, width, percent)
    fresh = second.where("linked").select("a", "b").unionByName(more.where("sure").select("a", "b"))
    if not fresh.isEmpty():
        parts = components(parts.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
                           .unionByName(fresh))

    nodes = nodes.select("node", "least")
    grouped = nodes.join(parts, "node")
    least = grouped.groupBy("component").agg(F.min("least").alias("of_component"))
    named = grouped.join(least, "component").select("node", "component", "of_component")
    by_node = nodes.join(named, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), F.coalesce("of_component", "least").alias("component_id"))
    full = own.where("n_shingles > 0").select("doc_id", "n_shingles", "node").join(by_node, "node")
    empty = own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty, allowMissingColumns=True)


def answers(rows: DataFrame, pairs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Exact answers of pairs: a, b, apart, linked."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(sets_of(rows, nodes.select("node", "least").join(ends, "node"), width), "compared-sets")
    return stored(compared(pairs, sets, percent), "answers")


def sets_of(rows: DataFrame, near: DataFrame, width: int) -> DataFrame:
    """The shingles of the nodes of ``near`` (node, least id): node, shingles."""
    schema = arrow_schema("own binary, shingles binary")
    bits = key_filter(near.select("least"), "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set()
        for batch in batch_slices(batches):
            out = []
            picked = in_filter(bits, batch.column(0).to_numpy()) | batch.column(1).to_numpy(zero_copy_only=False)
            for shingles in shingle_sets(batch.column(2).filter(pa.array(picked)), width):
                node = signature(shingles)
                if len(shingles) and node not in known:
                    known.add(node)
                    out.append((node, shingles.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)],
                                                 schema=schema)

    keyed = rows.select(F.xxhash64("doc_id").alias("hash"), F.col("doc_id").isNull().alias("unnamed"), "text")
    built = keyed.mapInArrow(run, "own binary, shingles binary")
    return (built.join(near.select("node"), F.col("own") == F.col("node")).select("node", "shingles")
            .dropDuplicates(["node"]))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """The rows that stay, with all columns: of each component the document with the smallest id.

    Null ids come last, so a component without another id keeps one row of them. Rows that share an id are documents of
    their own: each is told by id and set, the smallest set's signature stays, and rows that repeat both are reduced to
    one. Rows without shingles (null, empty and blank texts) stay. An empty table gives no rows. Columns may have any names.

    Only rows whose id a filter can't clear of dropped ones are written to the shared folder, cut into shingles again and
    shuffled with their text.
    """
    groups = stored(_grouped(docs, width, percent, doc_id, text).where(F.col("node").isNotNull()), "near-copies")
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("node").alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("first"))
    keys = groups.join(first, "component").groupBy("doc_id", "node").agg(
        F.first(stays).alias("stays"), F.count("*").alias("rows"))
    marks = stored(keys.where("NOT stays OR rows > 1").select(
        F.col("doc_id").alias("of"), F.col("node").alias("of_node"), "stays"), "near-marks")
    # an id filter of fixed size: rows it clears stay as they are
    named = docs.select(whole_row(docs)).select("row", F.col("row")[doc_id].cast("bigint").alias("doc_id"))
    maybe = may_be_in(key_filter(marks, "of"), "doc_id") | F.col("doc_id").isNull()
    marked = named.withColumn("maybe", maybe)
    # written first: filter and signatures in one stage would take two Python workers a core, which live on after it
    again = stored(marked.where("maybe").drop("maybe"), "near-again").withColumn(
        "node", _signatures(F.col("row")[text], width))
    joined = again.join(marks, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("node") == F.col("of_node")), "left")
    alone, several = joined.where(F.col("stays").isNull()), joined.where("stays")
    one = F.row_number().over(W.partitionBy("doc_id", "node").orderBy(F.col("row")[text]))
    several = several.withColumn("nth", one).where("nth = 1")
    kept = marked.where("NOT maybe").select("row").unionByName(alone.select("row")).unionByName(several.select("row"))
    return kept.select("row.*")


def _signatures(text: Column, width: int) -> Column:
    """The signature of each text's set, null without shingles. Marked so that a filter on it doesn't compute it twice."""
    @F.arrow_udf("binary")
    def signed(texts: pa.Array) -> pa.Array:
        return pa.array([signature(s) if len(s) else None for s in shingle_sets(texts, width)], pa.binary())

    return signed.asNondeterministic()(text)


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_groups(read_documents(spark, sf_dir), width=3, percent=90)
