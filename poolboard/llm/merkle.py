"""Merkle manifest of a table: one digest for all rows, one per source, and a proof for each row.

Only every few levels of a tree are kept. A proof needs the levels between as well: each aligned subtree makes them
again from its kept nodes, hands out the siblings and forgets them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_sql, map_rows, read_documents, share_of, stored, whole_row

ARITY = 3
#: Levels from one kept level to the next: an aligned subtree has at most ``ARITY ** STRIDE`` kept nodes.
STRIDE = 6
_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number below
_NODE = T.StructType().add("grp", "string").add("pos", "long").add("n", "long").add("digest", "string")


def digest_of(*fields: Column) -> Column:
    """Digest of fields in order: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    def shown(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[shown(f) for f in fields]), 256)


def joined_digest(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def heights(n: int) -> int:
    """Levels from ``n`` nodes up to a single one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def climb(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of an aligned subtree, level by level; an incomplete last run counts like the others."""
    rows = [digests]
    for _ in range(levels):
        rows.append([joined_digest(rows[-1][at:at + ARITY]) for at in range(0, len(rows[-1]), ARITY)])
    return rows


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``pos`` from 0 and the number of leaves ``n`` within each ``grp`` by ``order``, nulls first.

    Range partitions are written once, numbered alone and shifted by what lies before them; equal leaves are told apart
    by their row number, so a group, a key or copies of one row spread over partitions.
    """
    by = ["grp", *order, "row_no"]
    in_order = stored(leaves.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "grp", "digest", "row", F.monotonically_increasing_id().alias("slot")), "merkle-order")
    part = F.shiftright("slot", _LOCAL_BITS)
    upto = Window.partitionBy("in_grp").orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(in_order.groupBy(F.col("grp").alias("in_grp"), part.alias("in_part")).agg(
        F.min("slot").alias("first"), F.count("*").alias("rows")).select(
        "in_grp", "in_part", "first", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.partitionBy("in_grp")).alias("n")), "merkle-starts")
    found = in_order.join(starts, (in_order["grp"] == starts["in_grp"]) & (part == starts["in_part"]))
    return found.select("grp", (F.col("slot") - F.col("first") + F.col("before")).alias("pos"), "n", "digest", "row")


def _subtrees(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows of one aligned subtree after the other; rows are sorted, the first columns are its tree and number."""
    for _, found in groupby(rows, key=lambda r: r[:2]):
        yield list(found)


def _by_subtree(nodes: DataFrame) -> DataFrame:
    """Whole aligned subtrees in one task, in order: a group has at most ``ARITY ** STRIDE`` nodes, whatever the tree."""
    return nodes.repartition("grp", "sub").sortWithinPartitions("grp", "sub", "pos")


def _flat(slices: Iterator[list[tuple]]) -> Iterator[tuple]:
    for rows in slices:
        yield from rows


def _in_lists(rows: Iterable[tuple], size: int = 4096) -> Iterator[list[tuple]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    yield held


def next_kept_level(nodes: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The level ``stride`` higher, or the top of a tree that ends before it, from one kept level."""
    width = ARITY ** stride

    def tops(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        def found() -> Iterator[tuple]:
            for rows in _subtrees(_flat(slices)):
                grp, sub, _, n, _ = rows[0]
                levels = min(stride, heights(n))
                yield grp, sub, -(-n // ARITY ** levels), climb([r[4] for r in rows], levels)[-1][0]
        return _in_lists(found())

    many = nodes.where("n > 1").select("grp", F.expr(f"pos div {width}").alias("sub"), "pos", "n", "digest")
    return map_rows(_by_subtree(many), tops, _NODE)


class Tree(NamedTuple):
    """Kept levels of many trees, the leaves (with all their columns) first."""

    levels: list[DataFrame]
    stride: int

    def tops(self) -> DataFrame:
        """The one node at the top of each tree; a lone leaf is its own."""
        return _all([level.where("n = 1").select("grp", "digest") for level in self.levels])


def _all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def build_tree(leaves: DataFrame, stride: int = STRIDE) -> Tree:
    """Trees over placed ``leaves`` (grp, pos, n, digest, ...), one per ``grp``."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves]
    for _ in range(-(-heights(most) // stride)):
        levels.append(stored(next_kept_level(levels[-1].select("grp", "pos", "n", "digest"), stride), "merkle-level"))
    return Tree(levels, stride)


#: What a proof adds to a node: its place in each run on the way up, and the run's other nodes.
_PROOF = (T.StructType().add("places", T.ArrayType(T.IntegerType()))
          .add("siblings", T.ArrayType(T.ArrayType(T.StringType()))).add("subroot", "string").add("root", "string"))


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """The leaves, with their proofs. ``above`` has for each top (grp) its own way up: places, siblings, subroot, root.

    From the highest kept level down: each aligned subtree gets the way up from its top, makes its missing levels
    again, and adds to the way of each of its nodes.
    """
    width, ways = ARITY ** tree.stride, None
    for level in reversed(tree.levels):
        found = level.where("n = 1").join(above, "grp")
        if ways is not None:
            with_sub = T.StructType([_NODE["grp"], T.StructField("sub", T.LongType()), *level.schema[1:], *_PROOF])
            nodes = level.where("n > 1").withColumn("sub", F.expr(f"pos div {width}"))
            tops = ways.withColumn("sub", F.col("pos")).withColumn("pos", F.lit(-1).cast("long"))
            both = _with_columns(nodes, with_sub).unionByName(_with_columns(tops, with_sub))
            schema = T.StructType([*level.schema, *_PROOF])
            found = map_rows(_by_subtree(both), _proof_rows(tree.stride, len(level.columns) + 1), schema).unionByName(found)
        ways = found if level is tree.levels[0] else stored(found, "merkle-ways").drop("row")
    return ways


def _with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, null where ``df`` has none."""
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def _proof_rows(stride: int, end: int):
    """Rows with proofs from rows of whole subtrees, each behind the way up from its top; payload ends at column ``end``."""
    def run(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        def found() -> Iterator[tuple]:
            for (way, *rows) in _subtrees(_flat(slices)):
                n = rows[0][3]
                levels = climb([r[4] for r in rows], min(stride, heights(n)))[:-1]
                first = rows[0][2]
                up_places, up_siblings, subroot, root = way[end:]
                for row in rows:
                    at, places, siblings = row[2] - first, [], []
                    for nodes in levels:
                        start, place = at - at % ARITY, at % ARITY
                        run_of = nodes[start:start + ARITY]
                        places.append(place)
                        siblings.append(run_of[:place] + run_of[place + 1:])
                        at //= ARITY
                    yield (row[0], *row[2:end], places + list(up_places), siblings + [list(s) for s in up_siblings],
                           subroot, root)
        return _in_lists(found())
    return run


class Manifest(NamedTuple):
    """Trees of the groups' leaves, and the tree of their tops."""

    groups: Tree
    top: Tree

    def root(self) -> DataFrame:
        """One row with the root; none of an empty table."""
        return self.top.tops().select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """Every leaf with its ``row``, ``digest``, ``places`` and ``siblings`` level by level to the root, ``subroot`` and ``root``."""
        root = self.top.tops().select("grp", F.array().cast("array<int>").alias("places"),
                                      F.array().cast("array<array<string>>").alias("siblings"),
                                      F.lit("").alias("subroot"), F.col("digest").alias("root"))
        over = proofs(self.top, root).select(
            F.col("row.grp").alias("grp"), "places", "siblings", F.col("digest").alias("subroot"), "root")
        return proofs(self.groups, stored(over, "merkle-tops"))


def build_manifest(leaves: DataFrame, source: str, digest: str, order: list[str], stride: int = STRIDE) -> Manifest:
    """A manifest of ``leaves``: trees per ``source``, and one over their tops.

    Leaves ascend by ``order`` (nulls first) and digest; repeated rows are leaves of their own. Sources ascend bytewise,
    null first. An empty table has no root. Proofs return the columns of ``leaves`` in one column ``row``, so their
    names can't clash with others.
    """
    grp = F.when(F.col("row")[source].isNull(), "").otherwise(F.concat(F.lit("="), F.col("row")[source]))
    keys = [f"key{n}" for n in range(len(order))]
    rows = stored(leaves.select(whole_row(leaves)).select(
        grp.alias("grp"), F.col("row")[digest].alias("digest"), "row",
        *[F.col("row")[c].alias(k) for c, k in zip(order, keys, strict=True)],
        F.monotonically_increasing_id().alias("row_no")), "merkle-leaves")
    groups = build_tree(placed(rows, [*keys, "digest"]), stride)
    tops = stored(groups.tops().select(F.lit("").alias("grp"), F.struct("grp").alias("row"), "digest",
                                       F.lit(0).alias("row_no")), "merkle-subroots")
    return Manifest(groups, build_tree(placed(tops, ["row"]), stride))


def folded(leaf: Column, places: str = "places", siblings: str = "siblings") -> Column:
    """The root that follows from a leaf's digest and the siblings of a proof."""
    def up(acc: Column, step: Column) -> Column:
        others, place = step["siblings"], step["places"]
        return F.sha2(F.concat(F.array_join(F.slice(others, F.lit(1), place), ""), acc,
                               F.array_join(F.slice(others, place + 1, F.lit(ARITY)), "")), 256)
    steps = F.arrays_zip(F.col(places).alias("places"), F.col(siblings).alias("siblings"))
    return F.aggregate(steps, leaf, up)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``documents``, repeated ones too; a null id counts as the empty text to the choice of tampering."""
    docs = read_documents(spark, sf_dir)
    fields = ["doc_id", "source", "lang", "n_chars"]
    cut = F.when(share_of("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", digest_of(*map(F.col, fields), F.col("text")).alias("leaf"),
                         digest_of(*map(F.col, fields), cut).alias("tampered"))
    found = build_manifest(leaves, "source", "leaf", ["doc_id"]).proofs()
    found = found.withColumn("folded_root", folded(F.col("row.tampered")))
    return found.select(
        "row.doc_id", "row.leaf", "subroot", "root",
        F.sha2(F.array_join(F.flatten("siblings"), ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = f"""
WITH RECURSIVE shown AS (
  SELECT doc_id, source, text, {crc32_sql("doc_id")} % 2 = 0 AS cut,
         concat({", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))}) AS head
  FROM documents
), hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN cut THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
              ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS tampered
  FROM shown
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), nodes(source, lvl, pos, n, digest) AS (
  SELECT source, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY source, lvl, pos // {ARITY}, n
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops(lvl, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY lvl, pos // {ARITY}, n
), runs AS (
  SELECT false AS over, source, lvl, pos, pos // {ARITY} AS run, digest FROM nodes WHERE n > 1
  UNION ALL SELECT true, NULL, lvl, pos, pos // {ARITY}, digest FROM tops WHERE n > 1
), stops AS (
  SELECT l.source, l.pos AS leaf_pos, false AS over, k.lvl, l.pos // ({ARITY} ** k.lvl)::BIGINT AS at
  FROM leaves l JOIN (SELECT DISTINCT source, lvl FROM nodes WHERE n > 1) k ON l.source IS NOT DISTINCT FROM k.source
  UNION ALL
  SELECT l.source, l.pos, true, k.lvl, r.pos // ({ARITY} ** k.lvl)::BIGINT
  FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT DISTINCT lvl FROM tops WHERE n > 1) k
), steps AS (
  SELECT s.source, s.leaf_pos, s.over, s.lvl,
         coalesce(string_agg(r.digest, '' ORDER BY r.pos) FILTER (WHERE r.pos < s.at), '') || '|' ||
         coalesce(string_agg(r.digest, '' ORDER BY r.pos) FILTER (WHERE r.pos > s.at), '') AS step
  FROM stops s JOIN runs r ON r.over = s.over AND r.lvl = s.lvl AND r.run = s.at // {ARITY}
       AND (s.over OR r.source IS NOT DISTINCT FROM s.source)
  GROUP BY ALL
), ways AS (
  SELECT source, leaf_pos, list(step ORDER BY over, lvl) AS steps FROM steps GROUP BY ALL
), ends AS (
  SELECT l.doc_id, l.leaf, r.subroot, t.digest AS root, l.tampered, coalesce(w.steps, []) AS steps
  FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
  LEFT JOIN ways w ON l.source IS NOT DISTINCT FROM w.source AND l.pos = w.leaf_pos
), folded AS (
  SELECT *, list_reduce(list_concat([tampered], steps), lambda acc, s:
                        sha256(split_part(s, '|', 1) || acc || split_part(s, '|', 2))) AS folded_root
  FROM ends
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""
