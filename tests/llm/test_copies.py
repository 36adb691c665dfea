"""Exact groups and Jaccard groups against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from poolboard.llm import jaccard, trie_dedup
from poolboard.llm.components import components
from poolboard.llm.trie_dedup import Patricia, better

WORDS = [f"word{n}" for n in range(400)]
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "a\x0bb\x0c"), (8, "a b"),
         (9, "x" * 50_000), (10, "x" * 25_000 + " " + "x" * 25_000), (4, "a b"), (None, "ab c"), (None, None), (11, "abc")]


def rows_of(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))


def exact(rows):
    groups = {}
    for key, text in rows:
        bare = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(bare, []).append((-len(text or ""), key is None, key or 0, key))
    out = []
    for bare, members in groups.items():
        stays = min(members)
        taken = False
        for m in sorted(members):
            kept = m == stays and not taken
            taken |= kept
            out.append((m[3], stays[3], len(members), kept, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_a_trie_keeps_strings_apart_and_merges_equal_ones():
    rng = random.Random(0)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))).encode() for _ in range(800)]
    trie, plain = Patricia(), {}
    for n, word in enumerate(words):
        value = (rng.randint(1, 3), n, 1)
        trie.insert(word, value)
        plain[word] = better(plain[word], value) if word in plain else value
    assert dict(trie.terminals()) == plain
    assert trie.size == trie.weight(trie.root)


def test_spilled_subtrees_and_the_rest_are_the_whole_trie():
    trie, plain = Patricia(), {}
    for n in range(500):
        word = hashlib.md5(str(n).encode()).digest()
        trie.insert(word, (1, n, 1))
        plain[word] = (1, n, 1)
    before = trie.size
    spilled = dict(trie.spill())
    assert spilled and trie.size <= before // 2 and trie.size == trie.weight(trie.root)
    assert spilled | dict(trie.terminals()) == plain and not spilled.keys() & dict(trie.terminals()).keys()


@pytest.mark.parametrize("budget", [1, 1 << 20])
def test_exact_groups(spark, texts, budget):
    rng = random.Random(1)
    rows = EDGES + [(100 + n, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))) for n in range(300)]
    assert rows_of(trie_dedup.exact_groups(texts(rows).repartition(7), budget=budget)) == exact(rows)


def test_dropping_copies_keeps_columns_and_one_row_a_group(spark, texts):
    kept = trie_dedup.drop_copies(texts(EDGES).repartition(3))
    assert kept.columns == texts(EDGES).columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == len({r.split(", ")[4] for r in exact(EDGES)})
    assert sorted(repr(k) for k, _ in found) == sorted(r[1:].split(", ")[0] for r in exact(EDGES) if ", True, " in r)


def test_slices_of_a_batch_are_read_as_they_are(monkeypatch):
    import pyarrow as pa

    from poolboard.llm import common

    monkeypatch.setattr(common, "SLICE_BYTES", 50)
    values = [f"É{n} Çà\x0b NEU {'ñ' * n}" if n % 7 else None for n in range(40)]
    parts = list(common.batch_slices(iter([pa.RecordBatch.from_arrays([pa.array(values)], ["t"])])))
    assert len(parts) > 5
    words = [[w for w in row if w] for p in parts for row in common.lower_words(p.column(0)).to_pylist()]
    assert words == [[w.decode() for w in (v or "").encode().lower().split()] for v in values]


def test_no_rows(spark, texts):
    assert trie_dedup.exact_groups(texts([])).count() == 0
    assert trie_dedup.drop_copies(texts([])).count() == 0
    assert jaccard.near_groups(texts([])).count() == 0
    assert jaccard.drop_near_copies(texts([])).count() == 0


def near(rows, width, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k:k + width]) for k in range(len(words) - width + 1)}
                    if len(words) >= width else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = {}
    for n, (key, _) in enumerate(rows):
        if key is not None:
            least[find(n)] = min(least.get(find(n), key), key)
    return sorted(map(repr, ((key, len(sets[n]), least.get(find(n))) for n, (key, _) in enumerate(rows))))


def variants(seed, groups, members, length, edits):
    """Groups of near copies with few to many edits, so that similarities lie on both sides of the bound."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(length // 2, length))]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = f"v{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(text[:rng.randint(len(text) - 3, len(text))])))
    rng.shuffle(rows)
    return rows


MORE = [(9001, None), (9002, ""), (9003, "Only"), (9004, "only"), (9005, "ONLY \x0b"), (9006, "two words"),
        (None, "two  words"), (None, "nobody else"), (9003, "Only"), (9007, "only words")]


@pytest.mark.parametrize("width,percent,groups,members,length,edits", [
    (3, 90, 6, 30, 90, 6), (5, 80, 6, 30, 70, 5), (2, 60, 4, 25, 30, 9), (1, 100, 10, 6, 12, 1), (3, 90, 1, 150, 120, 5)])
def test_near_groups(spark, texts, width, percent, groups, members, length, edits):
    rows = variants(width * percent, groups, members, length, edits) + MORE
    assert rows_of(jaccard.near_groups(texts(rows).repartition(5), width, percent)) == near(rows, width, percent)


def test_blocks_of_long_lists_lose_nothing(monkeypatch):
    rng = random.Random(4)
    for block in (1, 2, 64):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        for _ in range(60):
            entries = sorted((rng.randint(5, 40), rng.randint(0, 4), bytes([rng.randint(0, 6)])) for _ in range(30))
            sizes, places, parts = (list(c) for c in zip(*entries, strict=True))
            heads = [b"%d" % h for h in jaccard.leaders(sizes, 80)]
            found = {tuple(sorted(p[:2])) for p in
                     jaccard.open_pairs(sizes, places, parts, heads, [None] * len(sizes), [bytes(8)] * len(sizes), 80)}
            most = max(set(parts), key=parts.count)
            assert parts.count(most) and found == {
                (x, y) for x in range(len(sizes)) for y in range(x + 1, len(sizes)) if parts[x] != parts[y]
                and jaccard.may_link(sizes[x], places[x], sizes[y], places[y], 80)}


def test_list_entries_without_a_partner_go_no_further(spark):
    """Round two carries an entry, with its parity, only if another one of its list can link with it."""
    shape = "shingle long, node binary, n int, place int"
    apart = [(1, b"%02d" % k, 20 << k, 0) for k in range(10)]  # sizes too far apart
    late = [(2, b"%02d" % k, 100, 9) for k in range(10)]  # nothing shared before the tenth place
    near = [(3, b"%02d" % k, 100 + k, 0) for k in range(10)] + [(3, b"far", 900, 0)]
    found = jaccard.first_pairs(spark.createDataFrame(apart + late + near, shape), 90).collect()
    assert {(r.shingle, r.node) for r in found if r.a is None} == {(3, bytes(x[1])) for x in near[:-1]}


def test_entries_with_a_partner_are_those_that_may_link():
    rng = np.random.default_rng(11)
    for size in [2, 3, 7, 20, 90] * 30:
        percent = int(rng.choice([50, 80, 90, 100]))
        n = np.sort(rng.integers(1, int(rng.choice([5, 60, 3000])), size)).tolist()
        places = [int(rng.integers(0, jaccard.prefix_length(x, percent))) for x in n]
        assert jaccard.with_partner(n, places, percent).tolist() == [
            x for x in range(size)
            if any(y != x and jaccard.may_link(n[x], places[x], n[y], places[y], percent) for y in range(size))]


def test_near_copies_leave_the_smallest_id(spark, texts):
    rows = variants(7, 3, 12, 60, 2) + [(500, "a b c d e f"), (501, "A b c d e f")]
    kept = {r.doc_id for r in jaccard.drop_near_copies(texts(rows)).collect()}
    assert {int(r.split(",")[0][1:]) for r in near(rows, 5, 80) if r.split(",")[0][1:] == r.split(", ")[2][:-1]} == kept


def test_near_copies_take_one_python_worker_a_task(spark, texts):
    """No branch of the kept rows' plan evaluates Python twice: each evaluation in a stage has a worker of its own."""
    kept = jaccard.drop_near_copies(texts(variants(7, 3, 12, 60, 2)))
    branches, found = [0], kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    for line in found:
        branches[-1] += "ArrowEvalPython" in line
        if "Relation" in line or "LogicalRDD" in line or "LocalRelation" in line:
            branches.append(0)
    assert max(branches) == 1, "\n".join(x[:150] for x in found)


@pytest.mark.parametrize("links", [[(n, n + 1) for n in range(60)], [(0, n) for n in range(1, 50)],
                                   [(n, n + 7) for n in range(40)], [(1, 2), (3, 4), (2, 3), (8, 9)]])
def test_components(spark, links):
    found = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    parent = {}
    for a, b in links:
        group = parent.setdefault(a, {a}) | parent.setdefault(b, {b})
        for node in group:
            parent[node] = group
    assert found == {node: min(group) for node, group in parent.items()}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_copies_go_by_id_and_text(spark, texts):
    """Rows that share an id are told apart; one of each group stays."""
    rng = random.Random(8)

    def words(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))
    a, b, c = words(80), words(90), words(70)
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b + " x"), (7, c), (7, c + " y"), (None, a), (None, c + " z"), (None, words(60)),
            (8, None), (8, ""), (8, " "), (9, words(3)), (9, words(3))]
    rows += [(None, d) for d in [words(50)] * 2]
    kept = jaccard.drop_near_copies(texts(rows).withColumnsRenamed({"word": "node", "part": "maybe"}).repartition(4))
    assert "node" in kept.columns and "maybe" in kept.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    ones = [r for r in found if r[1] in (c, c + " y")]
    assert len(ones) == 1 and ones[0][0] == 7
    wanted = [(3, a), (5, b), *ones, rows[9], *rows[10:15], rows[15]]
    assert found == sorted(wanted, key=repr)
