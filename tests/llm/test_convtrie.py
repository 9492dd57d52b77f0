"""Conversation tries against a brute-force trie, parentheses against a stack."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from redpen.llm import convtrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends_sha256"]


def brute(convs):
    """Rows of the trie of {id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def found(spark, convs, extra=()):
    rows = [(c, i, r, t, *extra) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, at int, role string, text string" + ", first string, members int" * bool(extra))
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    trie = convtrie.prefix_trie(turns, "conv_id", ["at"], "role", "text", ids)
    assert trie.columns == COLUMNS
    return sorted(map(tuple, trie.collect()), key=lambda r: (r[0], r[1]))


def some(seed, n, longest, words):
    rng = random.Random(seed)
    out = {}
    for c in rng.sample(range(-50, 10 * n), n):
        base = out[rng.choice(list(out))] if out and rng.random() < 0.7 else []
        out[c] = base[: rng.randint(0, len(base))] + [(rng.choice(["user", "", "x"]), rng.choice(words)) for _ in range(rng.randint(0, longest))]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6), min_size=1, max_size=12), st.sampled_from([2, 4, 512]))
def test_parentheses_against_a_stack(paths, block):
    held, convtrie.BLOCK = convtrie.BLOCK, block
    try:
        sorted_paths = sorted({("root", *p) for p in paths}, key=str)
        trie = convtrie.Trie(sorted_paths)
        tree, stack, close = trie.tree, [], {}
        for i, bit in enumerate(tree.bits.tolist()):
            if bit:
                stack.append(i)
            else:
                close[stack.pop()] = i
        assert not stack and all(tree.findclose(i) == j for i, j in close.items())
        nodes = {p[: i + 1] for p in sorted_paths for i in range(len(p))}
        assert len(trie.paths) == len(nodes) and set(trie.paths) == nodes
        value = np.arange(1, len(trie.paths) + 1)
        worth = dict(zip(trie.paths, value.tolist()))
        leaves, below = trie.sums(value, np.zeros(len(value), bool))
        for p, n, b in zip(trie.paths, leaves.tolist(), below.tolist()):
            under = [q for q in nodes if q[: len(p)] == p]
            assert n == sum(not any(len(r) > len(q) and r[: len(q)] == q for r in nodes) for q in under)
            assert b == sum(worth[q] for q in under if q != p)
    finally:
        convtrie.BLOCK = held


@pytest.mark.parametrize("seed, heavy", [(1, 1 << 16), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, heavy):
    monkeypatch.setattr(convtrie, "HEAVY", heavy)
    monkeypatch.setattr(convtrie, "CHUNK", 4)
    convs = some(seed, 150, 4, ["a", "b", "é", "", "long text"])
    assert found(spark, convs) == brute(convs)


def test_long_and_many_equal_conversations(spark):
    """One conversation holds most rows and lies in several tasks; its copy differs at the end; many others are equal."""
    turns = [("user", f"turn {i % 7}") for i in range(4000)]
    convs = {5: turns, 3: [*turns, ("user", "more")], 8: turns[:2000], **{100 + i: turns[:2] for i in range(300)}, 9: [], 11: [("user", "alone")]}
    got = found(spark, convs, ("clash", 1))
    want = {}
    for d in range(4002):  # the chain by hand, brute force would be quadratic
        alive = [c for c, t in convs.items() if len(t) >= d and (t[:d] == turns[:d] if d <= 4000 else c == 3)]
        want[d] = (min(alive), len(alive))
    chain = {r[1]: r for r in got if r[0] != 11}
    assert len(got) == 4003 and {d: (r[0], r[3]) for d, r in chain.items()} == want
    own = {d: (want[d][1] - 1) * len(turns[d - 1][1]) if 0 < d <= 4000 else 0 for d in range(4002)}
    left = 0
    for d in range(4001, -1, -1):
        left += own[d]
        assert chain[d][6] == left and chain[d][5] == (2 if d == 0 else 1)
    assert chain[2][7] == hashlib.sha256(",".join(str(100 + i) for i in range(300)).encode()).hexdigest()
    assert chain[4000][7] == hashlib.sha256(b"5").hexdigest() and chain[0][7] == hashlib.sha256(b"9").hexdigest()


def test_few_and_none(spark):
    one = {7: [("user", "x"), ("user", "y")], 8: [("user", "x"), ("user", "y")]}
    assert found(spark, one) == brute(one)
    assert found(spark, {4: []}) == brute({4: []})
    assert found(spark, {}) == []


def test_numbering_and_rebuilding(spark, tmp_path):
    """Nulls, ties and repeated rows through the query; conversations borrow turns of the next smaller multiple of five."""
    from redpen.llm.queries import op12_conversation_trie

    rng = random.Random(4)
    rows = [(rng.choice([None, *range(30), -3]), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(["user", None]), rng.choice(["a", "b", None, "c" * 5000]), 1) for _ in range(200)]
    rows += rows[:40]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    plain = defaultdict(list)
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            plain[c].append((role or "", text or ""))
    convs = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = plain.get(c - int(c - 5 * int(c / 5)), [])[:h] + turns[h:]
    got = sorted(map(tuple, op12_conversation_trie(spark, str(tmp_path)).collect()), key=lambda r: (r[0], r[1]))
    assert got == brute(convs)
    empty = spark.read.parquet(str(tmp_path / "conversations.parquet")).filter(F.lit(False))
    empty.write.parquet(str(tmp_path / "none/conversations.parquet"))
    assert op12_conversation_trie(spark, str(tmp_path / "none")).count() == 0
