"""The conversation trie against plain Python, over one block and over many rounds of blocks."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from poolboard.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def own_turns(rows):
    """Plain order of turns; repeated numbers by digest, as documented."""
    held = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            held.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [t[3] for t in sorted(turns)] for c, turns in held.items()}


def brute(conversations):
    nodes = {}
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:depth]), []).append(conv)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[:len(prefix)] == prefix]
        parents = {p[:-1] for p in nodes if p}
        ends = ",".join(str(c) for c in sorted(c for c in members if len(conversations[c]) == len(prefix)))
        out.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members),
                    sum(len(p) == len(prefix) + 1 for p in below), sum(p not in parents for p in below),
                    sum((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def some_rows(rng, convs, letters="ab", most=6):
    rows = []
    for conv in range(convs):
        hot = rng.random() < 0.35
        for turn in range(rng.randint(1, most)):
            rows.append((conv, turn, rng.choice(["user", None]), "hot first turn" if hot and turn == 0 else rng.choice(letters) + " x"))
    rows += [(convs, t, "user", f"long {t}") for t in range(150)] + [(convs + 1, t, "user", f"long {t}") for t in range(140)]
    return rows


def test_extents_are_those_of_a_scan():
    rng = np.random.default_rng(0)
    for size in (1, 2, 3, 17, 64, 100):
        values = np.concatenate([[-1], rng.integers(0, 4, size - 1)])
        table = prefix_trie.RangeMinima(values)
        row, depth = (a.ravel() for a in np.meshgrid(np.arange(size), np.arange(5)))
        left, right = table.left(row, depth), table.right(row, depth)
        for r, d, a, b in zip(row, depth, left, right, strict=True):
            first, last = r, r
            while first > 0 and values[first] >= d:
                first -= 1
            while last + 1 < size and values[last + 1] >= d:
                last += 1
            assert (a, b) == (first, last)


@pytest.mark.parametrize(("limit", "least"), [(1 << 16, 64), (20, 4)])
def test_trie_over_blocks(spark, limit, least):
    rows = some_rows(random.Random(limit), 300)
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(7)
    tree = prefix_trie.conversation_trie(prefix_trie.turn_paths(frame), limit, least)
    assert found(tree) == brute(own_turns(rows))


def test_rebuilt_conversations_with_nulls_ties_and_gaps(spark):
    rng = random.Random(3)
    rows = some_rows(rng, 60, letters="abc", most=4)
    rows = [r for r in rows if r[0] % 20 or r[0] == 20]  # families without their first conversation
    rows += [(5, None, "user", "ahead"), (5, 0, "user", "ahead"), (5, 0, "user", "ahead"), (None, 0, "user", "nobody"),
             (900, 0, None, None), (900, None, "", ""), (901, 1, "u", "word " * 50_000), (902, 1, "u", "\n\t\x0b \x00")]
    own = own_turns(rows)
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        whole[conv] = own.get(conv - conv % 20, [])[:h] + turns[h:]
    assert any(not turns for turns in whole.values())
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    rebuilt = prefix_trie.rebuilt(prefix_trie.turn_paths(frame))
    assert found(prefix_trie.conversation_trie(rebuilt, 50, 8)) == brute(whole)


def test_no_conversations_no_root(spark):
    frame = spark.createDataFrame([(None, 0, "user", "nobody", "a", "b")], SCHEMA)
    for rows in (frame, frame.limit(0)):
        assert found(prefix_trie.conversation_trie(prefix_trie.rebuilt(prefix_trie.turn_paths(rows)))) == []


def test_only_turnless_conversations_are_a_lone_root(spark):
    conversations = spark.createDataFrame([(7, []), (3, [])], "conv_id bigint, turns array<struct<turn:bigint,digest:string,words:bigint>>")
    assert found(prefix_trie.conversation_trie(conversations)) == brute({7: [], 3: []})
