"""Format spans against plain Python: likelihoods by counting, every candidate tried, whole runs of any length."""

import math
import random
import re
from collections import Counter

from poolboard.llm import secret_scan
from poolboard.llm.secret_scan import Automaton, base_spans

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
WORDS = ["internationalisation", "misunderstanding", "a", "of", "mail12.example.com", "between", "another", "question",
         "4785380592391139", "path/to/another", "mode=question", "question."]


def prose(rng, n=30):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def key(rng, letters, low, high):
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def likelihood(automaton, string):
    """By the counts of the states alone, in parts of 64."""
    total = 0.0
    for at in range(0, len(string), 64):
        state = 0
        for symbol in string[at:at + 64]:
            n = automaton.ended[state] + sum(automaton.passed[state].values())
            count = automaton.passed[state].get(symbol, 0)
            total += math.log2(count / n * (1 - 1e-4)) if count else math.log2(1e-4)
            state = automaton.after[state][symbol] if count else 0
        n = automaton.ended[state] + sum(automaton.passed[state].values())
        total += math.log2(max(1e-4, automaton.ended[state] / n))
    return total


def brute_force(rows):
    """Spans beside the base by id: everything counted in dictionaries, every candidate scored in full."""
    labelled, grams = [set(), set(), set()], Counter()
    for _, text in rows:
        base = base_spans(text)
        for kind, _, _, value in base:
            labelled[kind] |= {value[at:at + 64] for at in range(0, len(value), 64)}
        for m in re.finditer("[A-Za-z0-9+/_.=-]+", text):
            if len(m[0]) >= 6 and not any(a < m.end() and m.start() < b for _, a, b, _ in base):
                run = ["", "", *m[0], ""]
                grams.update(zip(run, run[1:], run[2:], strict=False))
    two, one, none = Counter(), Counter(), Counter()
    head2, head1 = Counter(), Counter()
    for (x, y, z), n in grams.items():
        two[y, z] += n
        head2[x, y] += n
        head1[y] += n
        one[z] += n
    total, size = sum(one.values()), len(ALPHABET) + 1

    def usual(string):
        run, bits = ["", "", *string, ""], 0.0
        own = list(zip(run, run[1:], run[2:], strict=False))
        mine = [Counter(key(*g) for g in own) for key in (lambda x, y, z: z, lambda x, y, z: (y, z), lambda x, y, z: y,
                                                          lambda x, y, z: (x, y, z), lambda x, y, z: (x, y))]
        for x, y, z in own:
            p = (max(one[z] - mine[0][z], 0) + 1) / (max(total - len(own), 0) + size)
            p = (max(two[y, z] - mine[1][y, z], 0) + 32 * p) / (max(head1[y] - mine[2][y], 0) + 32)
            p = (max(grams[x, y, z] - mine[3][x, y, z], 0) + 32 * p) / (max(head2[x, y] - mine[4][x, y], 0) + 32)
            bits += math.log2(p)
        return bits

    automata = [Automaton({v: 1 for v in values}) for values in labelled if values]

    def gain(value):
        good = [bits for f in automata if (bits := likelihood(f, value)) >= f.least * (len(value) + 1)]
        more = max(good) - usual(value) if good else -math.inf
        return more if more >= 4 else -math.inf

    def best(run, a, b):
        part, signs = run[a:b], "+/_.=-"
        inner = (a + len(part) - len(part.lstrip(signs)), a + len(part.rstrip(signs)))
        return max([(gain(run[x:y]), y - x, (x, y)) for x, y in [(a, b), inner] if y - x >= 6], default=(-math.inf, 0, 0))

    found = {}
    for n, text in rows:
        base, spans = base_spans(text), []
        for m in re.finditer("[A-Za-z0-9+/_.=-]+", text):
            if len(m[0]) >= 6:
                whole = best(m[0], 0, len(m[0]))
                pieces = [best(m[0], *part.span()) for part in re.finditer("[^=/]+", m[0])]
                chosen = pieces if max((p[0] for p in pieces), default=-math.inf) > whole[0] else [whole]
                spans += [(m.start() + p[0], m.start() + p[1]) for g, _, p in chosen if g > -math.inf]
        found[n] = [(a, b) for a, b in spans if not any(s < b and a < e for _, s, e, _ in base)]
    return found


def formats(row):
    return [tuple(map(int, s.split(":")[1:])) for s in row.spans.split(",") if s.startswith("format")]


def test_spans_are_those_of_plain_counts(spark, texts):
    rng = random.Random(11)
    hexes, capitals = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = []
    for n in range(200):
        loose = rng.choice([key(rng, hexes, 20, 23), "API=" + key(rng, capitals, 6, 15), "x/" + key(rng, capitals, 12, 15) + ".",
                            key(rng, ALPHABET, 6, 200), "==" + key(rng, capitals, 8, 15) + "/" + key(rng, capitals, 8, 15)])
        rows.append((n, f"{prose(rng)} token={key(rng, capitals, 6, 15)} {key(rng, hexes, 24, 40)} {loose} {prose(rng)}"))
    expected = brute_force(rows)
    found = {r.doc_id: sorted(formats(r)) for r in secret_scan.scan(texts(rows).repartition(4)).collect()}
    assert found == {n: sorted(spans) for n, spans in expected.items()}
    assert sum(map(len, found.values())) > 60


def test_short_credentials_of_letters_are_found_bare_and_behind_a_name(spark, texts):
    rng = random.Random(5)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = [(n, f"{prose(rng)} password: {key(rng, capitals, 6, 15)} {prose(rng)}") for n in range(300)]
    planted = {}
    for n in range(1000, 1060):
        value, front = key(rng, capitals, 6 + n % 10, 6 + n % 10), rng.choice(["", "DB_NAME=", "user/"])
        start = f"{prose(rng)} {front}"
        rows.append((n, f"{start}{value} {prose(rng)}"))
        planted[n] = (len(start), len(start) + len(value))
    rows += [(n, prose(rng)) for n in range(2000, 2100)]
    found = {r.doc_id: formats(r) for r in secret_scan.scan(texts(rows)).collect()}
    assert {n: found[n] for n in planted} == {n: [span] for n, span in planted.items()}
    assert not any(found[n] for n in range(2000, 2100))


def test_runs_of_millions_are_learned_and_scored_by_parts(spark, texts):
    rng = random.Random(2)
    run = "".join(rng.choices("ghijklmnopqrstuvwxyzGHIJLMNOPQRSTUVWXYZ234567", k=5_000_000))
    rows = [(n, f"token={run[n * 100:n * 100 + 64]}") for n in range(50)]
    rows += [(100, f"secret={run}"), (101, f"some words before {run}"), (102, None), (103, "")]
    docs = texts(rows)
    learned, _ = secret_scan.learn(docs.select("text"), 300)
    assert all(len(automaton.after) < 1000 for automaton in learned)
    found = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert found[100].n_assign == 1 and formats(found[101]) == [(18, 18 + len(run))]
    assert found[102].spans == found[103].spans == ""
    assert secret_scan.scan(texts([])).count() == 0
