"""The Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import pytest

from poolboard.llm import merkle

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode('utf-8', 'surrogatepass'))}:{value}"


def leaf_of(row, text):
    doc, _, lang, source, n_chars = row
    return digest("".join(map(shown, (doc, source, lang, n_chars, text))))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    steps = []
    for nodes in levels[:-1]:
        run = nodes[at - at % 3:at - at % 3 + 3]
        steps.append((at % 3, run[:at % 3] + run[at % 3 + 1:]))
        at //= 3
    return steps


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    ordered = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([leaf for _, _, leaf, _ in sorted(groups[s], key=lambda g: g[:3])]) for s in ordered}
    top = climb([trees[s][-1][0] for s in ordered])
    out = []
    for n, source in enumerate(ordered):
        for at, (_, _, leaf, row) in enumerate(sorted(groups[source], key=lambda g: g[:3])):
            steps = way(trees[source], at) + way(top, n)
            doc, text = row[:2]
            crc = zlib.crc32(b"" if doc is None else str(doc).encode())
            node = leaf_of(row, text.replace("\n", "") if text is not None and crc % 2 == 0 else text)
            for place, others in steps:
                node = digest("".join([*others[:place], node, *others[place:]]))
            out.append((doc, leaf, trees[source][-1][0], top[-1][0], digest("".join(o for _, s in steps for o in s)),
                        node, node == top[-1][0]))
    return sorted(out, key=repr)


def query(spark, folder, rows, schema=FIELDS, more=()):
    spark.createDataFrame([(*r, *more) for r in rows], schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, str(folder)).collect()), key=repr)


def some_rows(rng, count):
    """A hot source, small ones, single rows, nulls everywhere, repeated rows."""
    rows = [(rng.randint(-5, 10**9), f"a\nb {n}", "en", rng.choice(["hot", "hot", f"s{rng.randint(0, 12)}"]), n) for n in range(count)]
    rows += [(1, None, None, None, None), (None, "x\ny", "é", "hot", 3), (None, None, None, None, None), (2, "", "", "", 0),
             (3, "\n" * 100_000 + "x" * 100_000, "en", "long", 200_000), (4, "\n", "en", "€", 1), (4, "\n", "en", "€", 1)]
    return rows + rows[:5] * 2


@pytest.mark.parametrize("count", [1, 2, 3, 4, 10])
def test_small_trees(spark, tmp_path, count):
    rows = [(n, f"a\n{n}", "en", "one", n) for n in range(count)]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_the_query_over_several_kept_levels(spark, tmp_path):
    rows = some_rows(random.Random(4), 1500)
    schema = FIELDS + ", grp string, pos bigint, row string, root string"
    got = query(spark, tmp_path, rows, schema, ("g", 0, "r", "x"))
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("stride", [1, 2, 4])
def test_kept_levels_change_no_proof(spark, stride):
    rows = [(s, n, digest(f"{s} {n}")) for s in ("a", "b", None) for n in range({"a": 130, "b": 1, None: 9}[s])]
    leaves = spark.createDataFrame([(*r, 1, "x") for r in rows], "source string, n bigint, leaf string, pos int, places string")
    manifest = merkle.build_manifest(leaves, "source", "leaf", ["n"], stride)
    trees = {s: climb([leaf for t, _, leaf in rows if t == s]) for s in (None, "a", "b")}
    top = climb([trees[s][-1][0] for s in (None, "a", "b")])
    assert manifest.root().collect()[0].root == top[-1][0]
    assert manifest.groups.levels[0].count() == len(rows) and len(manifest.groups.levels) == 1 + -(-5 // stride)
    for r in manifest.proofs().collect():
        steps = way(trees[r.row.source], r.row.n) + way(top, [None, "a", "b"].index(r.row.source))
        assert (r.places, r.siblings) == ([p for p, _ in steps], [o for _, o in steps])


def test_a_proof_holds_for_its_leaf_alone(spark):
    from pyspark.sql import functions as F

    leaves = spark.createDataFrame([("s", n, digest(str(n))) for n in range(30)], "source string, n bigint, leaf string")
    found = merkle.build_manifest(leaves, "source", "leaf", ["n"], 2).proofs()
    good, bad = merkle.folded(F.col("digest")), merkle.folded(F.sha2("digest", 256))
    assert found.where(good == F.col("root")).count() == 30 and found.where(bad == F.col("root")).count() == 0


def test_an_empty_table_has_no_root(spark, tmp_path):
    assert query(spark, tmp_path, []) == []
