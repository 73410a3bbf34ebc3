"""The prefix trie against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpuswright.llm import registry, trie

SF = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, rebuild=True):
    """Rows of (conv_id, turn, role, text); every node's row."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    convs = turns
    if rebuild:
        convs = {}
        for c, t in turns.items():
            h = zlib.crc32(str(c).encode()) % 9
            base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
            convs[c] = turns.get(base, [])[:h] + t[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(below), leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], "conv_id long, turn int, role string, text string, place int, depth string").repartition(4)


def test_trie_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(-12, 150):
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, t, ["user", "assistant"][t % 2], ["héllo", "", "why", None][int(rng.integers(0, 4)) if t > 1 else 0]))
    rows += [(400, None, None, None), (400, None, "", ""), (400, 1, "b", "x"), (400, 1, "a", "y"), (400, 1, "a", "y"), (None, 1, "user", "lost")]
    rows = [r for r in rows if r[0] not in (5, 30)]  # bases that are not there
    assert got(trie.op11(frame(spark, rows))) == plain(rows)
    assert got(trie.trie(trie.whole(trie.placed(frame(spark, rows))))) == plain(rows, rebuild=False)


def test_copies_and_nested_branches(spark):
    # many copies of one long conversation, and each k-th leaves the last one's path after k turns
    rows = [(c, t, "u", f"text {t}") for c in range(40) for t in range(30)]
    rows += [(1000 - k, t, "u", f"other {t}" if t < k else f"{k}") for k in range(1, 25) for t in range(k + 1)]
    df = trie.trie(trie.whole(trie.placed(frame(spark, rows))))
    assert got(df) == plain(rows, rebuild=False)


def test_runs_of_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 3)
    monkeypatch.setattr(trie, "ROWS", 50)
    rows = [(c, 0, "u", "same") for c in range(200)] + [(c, 0, "u", f"{c}") for c in range(200, 230)]
    assert got(trie.trie(trie.whole(trie.placed(frame(spark, rows))))) == plain(rows, rebuild=False)


def test_texts_of_nodes_and_nothing(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "v", "b"), (2, 0, "u", "a"), (3, 0, "v", None)]
    df = frame(spark, rows)
    nodes = trie.last_turns(trie.trie(trie.whole(trie.placed(df))), df)
    assert {(r.conv_id, r.depth, r.role, r.text) for r in nodes.collect()} == {(1, 0, None, None), (1, 1, "u", "a"), (1, 2, "v", "b"), (3, 1, "v", "")}
    assert trie.op11(df.limit(0)).count() == 0
    assert trie.op11(df.where("false")).columns == NAMES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_trie_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.queries()["op11_prefix_trie"](spark, path)) == plain(rows)
