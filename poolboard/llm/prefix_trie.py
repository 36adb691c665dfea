"""Prefix trie of conversations: who shares the first turns with whom.

Conversations are sorted by the digests of their turns. Neighbours' common lengths, under a sparse table of range minima,
give each candidate prefix its members: the rows to the left and right as far as the minimum allows, found by two
independent binary searches over powers of two.

The sorted rows are cut into blocks. A prefix that reaches neither end of its block is done there. Those that do are
prefixes of the block's first or last row; these two rows, with what they have gathered so far, are the rows of the next
round, until one block is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch_slices, crc32_sql, shared_path, stored

#: A block ends at this many prefixes, but not before ``ROWS`` rows: each round leaves two rows of a block.
ENTRIES, ROWS = 1 << 16, 64
#: Characters of a turn's digest (128 bits).
DIGEST = 32
WORD = r"[^\x20\x09-\x0D]+"
_NOBODY = np.iinfo(np.int64).max
_NO_ENDS = hashlib.sha256(b"").hexdigest()

#: What a prefix gathers: members, the smallest one, children, childless prefixes at or below it, saved tokens.
_SUMS = ("members", "smallest", "children", "leaves", "saved")


def _long_lists(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(T.LongType())) for n in names]


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


#: Rows of a round: a path of digests, the words of its turns, and sums of each of its prefixes, the empty one first.
EDGE = T.StructType([*_longs("block", "side"), *_texts("path"), *_long_lists("words", *_SUMS)])
NODE = T.StructType([*_longs("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"),
                     *_texts("ends_sha256", "key"), *_longs("up_block", "up_side")])
#: The smallest members of a round's row by prefix; those up to ``up_depth`` are known to a row of the next round.
ANSWER = T.StructType([*_longs("block", "side"), *_long_lists("smallest"), *_longs("up_block", "up_side", "up_depth")])
#: Members that end at a prefix, in pieces by block.
ENDS = T.StructType([*_texts("key"), *_longs("block"), *_texts("ids")])
KINDS = {"node": NODE, "edge": EDGE, "answer": ANSWER, "ends": ENDS}
OUT = T.StructType([*_texts("kind"), *[T.StructField(k, t) for k, t in KINDS.items()]])


def common_lengths(turns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each row the number of first turns it shares with the row before it; -1 for the first row."""
    starts = np.cumsum(lengths) - lengths
    shared = np.minimum(lengths[1:], lengths[:-1])
    row = np.repeat(np.arange(1, len(lengths)), shared)
    turn = np.arange(shared.sum()) - np.repeat(np.cumsum(shared) - shared, shared)
    differ = turns[starts[row] + turn] != turns[starts[row - 1] + turn]
    np.minimum.at(shared, row[differ] - 1, turn[differ])
    return np.concatenate([[-1], shared]).astype(np.int64)


class RangeMinima:
    """Sparse table: ``levels[k][i]`` is the smallest of 2**k values from ``i`` on."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def left(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row that shares ``depth`` turns with each ``row``: values after it, up to the row's, reach the depth."""
        at = row.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            start = at - (1 << k) + 1
            reach = (start >= 1) & (self.levels[k][np.maximum(start, 0)] >= depth)
            at[reach] -= 1 << k
        return at

    def right(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row that shares ``depth`` turns with each ``row``."""
        at = row.copy()
        for k, level in reversed(list(enumerate(self.levels))):
            inside = at + 1 < len(level)
            reach = inside & (level[np.where(inside, at + 1, 0)] >= depth)
            at[reach] += 1 << k
        return at


class Block:
    """Prefixes of sorted rows: their intervals, and sums over the intervals and over the subtrees."""

    def __init__(self, paths: list[str], words: np.ndarray, sums: dict[str, np.ndarray], whole: bool):
        """``words`` has a value per turn, ``sums`` one per prefix, row by row; ``whole``: no rows lie outside."""
        self.turns = np.frombuffer("".join(paths).encode(), dtype=f"S{DIGEST}")
        self.lengths = np.array([len(p) // DIGEST for p in paths], dtype=np.int64)
        self.rows = len(paths)
        self.shared = common_lengths(self.turns, self.lengths)
        minima = RangeMinima(self.shared)
        # candidates: each row with each of its prefixes
        sizes = self.lengths + 1
        self.first = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(self.rows), sizes)
        depth = np.arange(sizes.sum()) - np.repeat(self.first, sizes)
        left = minima.left(row, depth)
        # a prefix is numbered where it occurs first: its subtree follows it
        new = self.lengths - self.shared
        self.before = np.concatenate([[0], np.cumsum(new)])
        self.node = self.before[left] + depth - self.shared[left] - 1
        owner = left == row
        self.left, self.depth = row[owner], depth[owner]
        self.right = minima.right(self.left, self.depth)
        self.end = self.before[self.right + 1]
        self.parent = np.full(len(self.left), -1)
        below = self.depth > 0
        self.parent[below] = self.node[self.first[self.left[below]] + self.depth[below] - 1]
        self.words = np.zeros(len(self.left), dtype=np.int64)
        self.words[below] = words[(np.cumsum(self.lengths) - self.lengths)[self.left[below]] + self.depth[below] - 1]
        count = len(self.left)
        self.sums = {name: np.zeros(count, dtype=np.int64) for name in _SUMS if name != "smallest"}
        for name, total in self.sums.items():
            np.add.at(total, self.node, sums[name])
        self.sums["smallest"] = np.full(count, _NOBODY)
        np.minimum.at(self.sums["smallest"], self.node, sums["smallest"])
        self.open = np.full(count, False) if whole else (self.left == 0) | (self.right == self.rows - 1)
        self._add_up()

    def _add_up(self) -> None:
        """Totals of the closed prefixes; an open one gets those of its closed children."""
        closed, inner = ~self.open, self.parent >= 0
        np.add.at(self.sums["children"], self.parent[closed & inner], 1)
        own = {"leaves": self.sums["leaves"] + (self.sums["children"] == 0),
               "saved": self.sums["saved"] + (self.sums["members"] - 1) * self.words}
        lowest = closed & inner & self.open[np.maximum(self.parent, 0)]
        for name, value in own.items():
            upto = np.concatenate([[0], np.cumsum(np.where(closed, value, 0))])
            total = upto[self.end] - upto[:-1]
            kept = self.sums[name]
            kept[closed] = total[closed]
            np.add.at(kept, self.parent[lowest], total[lowest])

    def edges(self) -> list[tuple[int, int, np.ndarray]]:
        """The first and the last row as (side, row, which of its prefixes it stands for: each once)."""
        found = [(0, 0, np.full(self.lengths[0] + 1, True))]
        if self.rows > 1:
            last = self.rows - 1
            found.append((1, last, self.left[self.nodes_of(last)] != 0))
        return found

    def nodes_of(self, row: int) -> np.ndarray:
        return self.node[self.first[row]:self.first[row] + self.lengths[row] + 1]

    def ways_up(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row, which edge shares more first turns with it, and how many; -1 turns if nothing is open."""
        if not self.open.any():
            return np.zeros(self.rows, dtype=np.int64), np.full(self.rows, -1)
        low = np.minimum.accumulate(np.concatenate([self.lengths[:1], self.shared[1:]]))
        high = np.minimum.accumulate(np.concatenate([self.lengths[-1:], self.shared[:0:-1]]))[::-1]
        return (high > low).astype(np.int64), np.maximum(low, high)


def _keys(path: str) -> list[str]:
    """A digest for each prefix of a path."""
    state, found = hashlib.sha256(), []
    for at in range(0, len(path) + 1, DIGEST):
        found.append(state.copy().hexdigest())
        state.update(path[at:at + DIGEST].encode())
    return found


def _blocks(slices: Iterator[pa.RecordBatch], limit: int, least: int) -> Iterator[pa.Table]:
    """Rows in order, cut where a block has ``limit`` prefixes and ``least`` rows."""
    held, entries, rows = [], 0, 0
    for part in slices:
        sizes = pa.compute.binary_length(part.column("path")).to_numpy(zero_copy_only=False) // DIGEST + 1
        at = 0
        for n, size in enumerate(sizes.tolist()):
            entries, rows = entries + size, rows + 1
            if entries >= limit and rows >= least:
                yield pa.Table.from_batches([*held, part.slice(at, n + 1 - at)])
                held, entries, rows, at = [], 0, 0, n + 1
        if at < part.num_rows:
            held.append(part.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _solve(conversations: bool, whole: bool, limit: int, least: int):
    """Task over sorted rows: ``conversations``, or edges of the round before; ``whole``: all rows are in one block."""
    import pyspark

    schema = arrow_schema(OUT)

    def out(kind: str, columns: dict[str, object], rows: int) -> pa.RecordBatch:
        own = schema.field(kind).type
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in own]
        value = pa.StructArray.from_arrays(arrays, fields=list(own))
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * rows) if f.name == "kind" else value if f.name == kind else pa.nulls(rows, f.type)
             for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pyspark.TaskContext.get().partitionId() << 32
        for table in _one(batches) if whole else _blocks(batch_slices(batches), limit, least):
            yield from solve(table, number)
            number += 1

    def _one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held)

    def solve(table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        paths = table.column("path").to_pylist()
        if conversations:
            ids = table.column("conv_id").to_numpy()
            sizes = np.array([len(p) // DIGEST + 1 for p in paths])
            zeros = np.zeros(sizes.sum(), dtype=np.int64)
            sums = {name: zeros for name in _SUMS} | {"members": zeros + 1, "smallest": np.repeat(ids, sizes)}
        else:
            sums = {name: _flat(table, name) for name in _SUMS}
        block = Block(paths, _flat(table, "words"), sums, whole)
        side, shared = block.ways_up()
        ends = np.full(len(block.left), _NO_ENDS, dtype=object)
        if conversations:
            same = (block.shared[1:] == block.lengths[1:]) & (block.shared[1:] == block.lengths[:-1])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            pieces = []
            for a, b in zip(starts, [*starts[1:], len(paths)], strict=True):
                text, node = ",".join(map(str, ids[a:b].tolist())), block.nodes_of(a)[-1]
                if block.open[node]:
                    pieces.append((hashlib.sha256(paths[a].encode()).hexdigest(), number, text))
                else:
                    ends[node] = hashlib.sha256(text.encode()).hexdigest()
            if pieces:
                yield out("ends", dict(zip(("key", "block", "ids"), zip(*pieces, strict=True), strict=True)), len(pieces))
        done = np.flatnonzero(~block.open)
        if len(done):
            parent, up = block.parent[done], np.full(len(done), False)
            up[parent >= 0] = block.open[parent[parent >= 0]]
            known = (parent >= 0) & ~up
            row = block.left[done]
            smallest = block.sums["smallest"]
            columns = {
                "conv_id": smallest[done], "depth": block.depth[done],
                "parent_conv_id": pa.array(smallest[np.maximum(parent, 0)], mask=~known),
                "n_convs": block.sums["members"][done], "n_children": block.sums["children"][done],
                "n_leaves": block.sums["leaves"][done], "saved_tokens": block.sums["saved"][done],
                "up_block": pa.array(np.full(len(done), number), mask=~up), "up_side": pa.array(side[row], mask=~up)}
            if conversations:
                columns["ends_sha256"] = ends[done]
            else:
                keys = {n: _keys(paths[n]) for n in set(row.tolist())}
                columns["key"] = [keys[r][d] for r, d in zip(row.tolist(), block.depth[done].tolist(), strict=True)]
            yield out("node", columns, len(done))
        if not conversations:
            known = [[None if block.open[n] else int(block.sums["smallest"][n]) for n in block.nodes_of(r)]
                     for r in range(block.rows)]
            yield out("answer", {"block": table.column("block").to_pylist(), "side": table.column("side").to_pylist(),
                                 "smallest": known, "up_block": np.full(block.rows, number), "up_side": side,
                                 "up_depth": shared}, block.rows)
        if not whole:
            turn = np.cumsum(block.lengths) - block.lengths
            words = _flat(table, "words")
            found = []
            for at, row, stands in block.edges():
                nodes = block.nodes_of(row)
                found.append((number, at, paths[row], words[turn[row]:turn[row] + block.lengths[row]].tolist(), *[
                    np.where(stands, block.sums[name][nodes], _NOBODY if name == "smallest" else 0).tolist()
                    for name in _SUMS]))
            yield out("edge", dict(zip(EDGE.names, zip(*found, strict=True), strict=True)), len(found))

    return run


def _round(rows: DataFrame, conversations: bool, whole: bool, limit: int, least: int) -> dict[str, DataFrame]:
    """One round over sorted rows, written and read back by kind."""
    path = shared_path(rows.sparkSession, "trie-round")
    rows.mapInArrow(_solve(conversations, whole, limit, least), OUT).write.partitionBy("kind").parquet(path)
    read = rows.sparkSession.read.schema(OUT).parquet(path)
    return {kind: read.where(F.col("kind") == kind).select(f"{kind}.*") for kind in KINDS}


def trie(paths: DataFrame, limit: int = ENTRIES, least: int = ROWS) -> DataFrame:
    """Prefixes of ``paths`` (conv_id, path, words) with the sums of the contract; ids of conversations are distinct.

    A block ends at ``limit`` prefixes and ``least`` rows, so few rounds are needed: each leaves two rows of a block. A
    round is spread over tasks until no more than ``limit`` prefixes are left. A conversation's digests are one row.
    """
    in_order = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    rounds = [_round(in_order, True, False, limit, least)]
    before = None
    while True:
        edges = rounds[-1]["edge"]
        n, entries = edges.agg(F.count("*"), F.sum(F.size("members"))).first()
        whole = not n or entries <= limit or (before is not None and 2 * n > before)
        order = ["path", "block", "side"]
        spread = edges.coalesce(1) if whole else edges.repartitionByRange(max(2, entries // (8 * limit)), *order)
        rounds.append(_round(spread.sortWithinPartitions(*order), False, whole, limit, least))
        if whole:
            break
        before = n
    ends = stored(_ends_digests(rounds[0]["ends"]), "trie-ends")
    answers, nodes = None, []
    for at in range(len(rounds) - 1, -1, -1):
        found = rounds[at]["node"]
        if answers is not None:
            found = _ask(found, answers).withColumn("parent_conv_id", F.coalesce(
                "parent_conv_id", F.get("up_smallest", F.col("depth") - 1)))
        if at:
            found = found.drop("ends_sha256").join(ends, "key", "left").withColumn(
                "ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
            own = rounds[at]["answer"]
            if answers is not None:
                filled = F.transform("smallest", lambda value, n: F.coalesce(value, F.get("up_smallest", n)))
                own = _ask(own, answers).withColumn("smallest", filled)
            answers = stored(own.select("block", "side", "smallest"), "trie-answers")
        nodes.append(found.select(*[c for c in NODE.names if c not in ("key", "up_block", "up_side")]))
    whole = nodes[0]
    for more in nodes[1:]:
        whole = whole.unionByName(more)
    return whole


def _ask(df: DataFrame, answers: DataFrame) -> DataFrame:
    """Add what the next round's row knows; an asked row serves the rows of one block."""
    up = answers.select(F.col("block").alias("up_block"), F.col("side").alias("up_side"), F.col("smallest").alias("up_smallest"))
    return df.join(up, ["up_block", "up_side"], "left")


def _ends_digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the joined ids of a key whose pieces lie in several blocks; a piece is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batch_slices(batches):
            done = []
            for name, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(
        run, "key string, ends_sha256 string")


def turn_paths(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turns) from rows (conv_id, turn, role, text): digest and words of each turn, in order.

    Turns ascend by number, null first; turns that repeat a number ascend by their digest. Null roles and texts are
    empty. Rows without a conv_id belong to no conversation and are left out. Texts are not shuffled.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(DIGEST))
    turn = F.struct(F.col("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy(
        "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Each conversation behind the first h turns of its family's first one instead of its own; h is its crc32 modulo ``most``.

    A family is ``family`` ids in a row, so the join has groups of at most that size.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = conversations.select(F.col("conv_id").alias("of"), F.slice("turns", 1, most - 1).alias("head"))
    whole = F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0)), F.slice("turns", h + 1, F.size("turns")))
    members = conversations.withColumn("of", F.col("conv_id") - F.col("conv_id") % family)
    return members.join(heads, "of", "left").select("conv_id", whole.alias("turns"))


def conversation_trie(conversations: DataFrame, limit: int = ENTRIES, least: int = ROWS) -> DataFrame:
    """The trie of conversations (conv_id, turns) as ``turn_paths`` gives them: a row per distinct prefix."""
    return trie(conversations.select("conv_id", F.array_join(F.col("turns.digest"), "").alias("path"),
                                     F.col("turns.words").alias("words")), limit, least)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty table has no prefixes, not even the root."""
    own = stored(turn_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")
    return conversation_trie(rebuilt(own))


OP11_SQL = f"""
WITH rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(f.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM (SELECT conv_id, {crc32_sql("conv_id")} % 4 AS h, list(t ORDER BY turn NULLS FIRST, digest) AS turns
        FROM (SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
                     sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
              FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id) c
  LEFT JOIN (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, digest) AS turns
             FROM (SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
                          sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
                   FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id) f
  ON f.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, depth, len(turns) = depth AS ends, turns[1:depth] AS prefix, turns[1:depth - 1] AS shorter
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT depth, prefix, any_value(shorter) AS shorter, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(prefix)[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS words
  FROM prefixes GROUP BY depth, prefix
), children AS (
  SELECT depth - 1 AS depth, shorter AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, unnest(range(n.depth + 1)) AS top
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
), sums AS (
  SELECT top AS depth, prefix[1:top] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
         sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM below GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
       s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.prefix = n.prefix
LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.shorter
"""
