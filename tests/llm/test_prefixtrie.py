import hashlib
import random
import zlib

import pytest

from reelspan.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(rebuilt[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **bounds):
    turns = prefixtrie.Scratch(spark, "t").write(prefixtrie.ordered_turns(table(spark, rows)), "turns")
    nodes = prefixtrie.prefix_trie(prefixtrie.shared_openings(turns), turns.where("at = 1").select("conv_id"), **bounds)
    return nodes


def conversations(seed):
    r = random.Random(seed)
    texts = ["", "a", "ab", "é𝄞", None, "b" * 50]
    rows = []
    for c in [*range(40), *range(95, 110), 205, 207, 300, 301, 302, -3, -100, -101]:
        for turn in range(r.randrange(1, 9)):
            rows.append((c, turn if turn else None, r.choice(["user", "bot", None]), r.choice(texts[: r.choice([2, 6])])))
    rows += [(7, 3, "user", "same"), (7, 3, "user", "same"), (7, 3, "bot", "tie"), (None, 1, "user", "nobody")]
    rows += [(c, t, "user", f"t{t}") for c in (400, 401) for t in range(30 + c % 2)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("deep", [0, 3, 1000])
def test_equals_brute_force(spark, deep):
    rows = conversations(deep)
    got = found(spark, rows, deep_conversations=deep).drop("t1", "t2")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_edges(spark):
    assert found(spark, []).count() == 0
    only = [(1, 0, None, None)]
    assert sorted(map(tuple, found(spark, only).drop("t1", "t2").collect()), key=str) == brute(only)
    text = "long " * 200_000
    rows = [(200, 0, "user", text), (200, 1, "bot", "x"), *[(200 + k, t, "bot", "y") for k in range(1, 9) for t in range(6)]]
    assert sorted(map(tuple, found(spark, rows).drop("t1", "t2").collect()), key=str) == brute(rows)


def test_texts(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, None, "there")]
    turns = prefixtrie.ordered_turns(table(spark, rows))
    nodes = prefixtrie.prefix_trie(turns, turns.select("conv_id"))
    got = {r.depth: (r.role, r.text) for r in prefixtrie.with_texts(nodes, table(spark, rows)).collect()}
    assert got == {0: (None, None), 1: ("user", "hello"), 2: ("", "there")}


def test_ids_of_a_node_in_many_rows(spark):
    ids = [*range(0, 30_000, 3), -5, -9000]
    rows = [(c, 0, "user", "hi") for c in ids]
    turns = prefixtrie.ordered_turns(table(spark, rows))
    nodes = prefixtrie.prefix_trie(turns, turns.select("conv_id")).where("depth = 1").collect()
    assert [(r.n_convs, r.ends_sha256) for r in nodes] == [(len(ids), hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest())]
