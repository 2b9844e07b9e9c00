"""Exact search, hard negatives and the prefix trie against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from varve.llm import negatives, prefixtrie, topk
from varve.llm import vectors as V

VECTORS = "vec_id bigint, embedding array<double>, label int"


def whole(vector):
    """floor(256 x) as integers, None for a vector that takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in vector):
        return None
    return [math.floor(Fraction(x) * 256) for x in vector]


def inner(a, b):
    return max(-V.MOST, min(V.MOST, sum(x * y for x, y in zip(a, b))))


def rows_by_id(rows):
    """vec_id -> smallest (vector, rest) of the rows that take part."""
    out = {}
    for vec_id, vector, *rest in rows:
        if vec_id is not None and whole(vector) is not None:
            key = (list(vector), *rest)
            out[vec_id] = min(out.get(vec_id, key), key)
    return out


def brute_topk(rows, k, every):
    v = {i: whole(r[0]) for i, r in rows_by_id([r[:2] for r in rows]).items()}
    out = []
    for q in v:
        if q % every == 0:
            best = sorted(((-inner(v[q], v[c]), c) for c in v if c != q))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def brute_negatives(rows, every):
    kept = rows_by_id([r for r in rows if r[2] is not None])
    v, label = {i: whole(r[0]) for i, r in kept.items()}, {i: r[1] for i, r in kept.items()}
    out = []
    for a in v:
        if a % every:
            continue
        scored = sorted((-inner(v[a], v[c]), c) for c in v if c != a)
        for s, p in [x for x in scored if label[x[1]] == label[a]][:5]:
            ok = [(n, c) for n, c in scored if label[c] != label[a] and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(a, p, r + 1, c, -s, -n) for r, (n, c) in enumerate(ok)]
    return sorted(out)


def made_vectors(seed, n, width, clusters=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, width)) / width**0.5
    if clusters:
        m = m * 0.02 + rng.normal(size=(clusters, width))[rng.integers(0, clusters, n)]
    return [(i, [float(x) for x in m[i]], int(rng.integers(0, 4))) for i in range(n)]


ODD = [
    (None, [1.0, 2.0], 1), (1000, None, 1), (1001, [None, 1.0], 1), (1002, [float("nan"), 1.0], 1), (1003, [float("inf"), 1.0], 1),
    (1004, [1e308, 1.0], 2), (1010, [], 1), (1020, [0.5], None), (1020, [0.25, 0.5], 1), (1020, [0.25, 0.125], 2), (1030, [0.0, 0.0], 1),
    (1040, [3.0, 1.0, -1.0], 1), (1050, [3.0, 1.0, -1.0], 2), (1060, [3.0, 1.0, -1.0], 1), (-10, [2.0, 1.0, -1.0], 3), (-10, [2.0, 1.0, -1.0], 3),
]
CASES = {
    "random": (made_vectors(1, 300, 8), 10),
    "clustered": (made_vectors(2, 400, 6, clusters=7), 10),
    "one vector": ([(i, [0.5, 0.25], i % 2) for i in range(0, 300)], 10),
    "odd": (made_vectors(3, 60, 3) + ODD, 5),
    "huge": ([(i, [(-1.0) ** i * 10.0 ** (i % 9), 3e9 + i, 1e16 * (i % 3)], i % 3) for i in range(60)], 5),
    "beyond": ([(i, [1e200 * (i % 4 - 1), float(i)], i % 2) for i in range(30)], 5),
    "few": ([(0, [1.0], 1), (50, [2.0], 1), (7, [1.5], 2)], 1),
    "none": ([], 5),
}


@pytest.mark.parametrize("name", CASES)
def test_topk_equals_brute_force(spark, name):
    rows, every = CASES[name]
    got = sorted(map(tuple, topk.nearest(spark.createDataFrame(rows, VECTORS), every=every).collect()))
    assert got == brute_topk(rows, 5, every)


@pytest.mark.parametrize("name", CASES)
def test_negatives_equal_brute_force(spark, name):
    rows, every = CASES[name]
    got = sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, VECTORS), every=every).collect()))
    assert got == brute_negatives(rows, every)


def test_vectors_keep_to_their_columns(spark):
    """Extra columns, also of names the operators use, change nothing."""
    rows, every = CASES["clustered"]
    extra = "block", "asks", "floor", "cell", "limits", "score", "slot", "query_id", "anchor_id", "rank", "width"
    df = spark.createDataFrame(rows, VECTORS)
    more = df.selectExpr("*", *[f"'x' AS {c}" for c in extra])
    assert sorted(topk.nearest(df, every=every).collect()) == sorted(topk.nearest(more, every=every).collect())
    assert sorted(negatives.mine(df, every=every).collect()) == sorted(negatives.mine(more, every=every).collect())


def test_pivots_eliminate_on_clustered_vectors(monkeypatch):
    """A query evaluates a small part of a block whose rows lie in clusters, and gets the exact result."""
    m = np.floor(256 * np.array([r[1] for r in made_vectors(4, 4000, 16, clusters=40)]))
    pivots = topk.Pivots(m[:1000], 32)
    import pyarrow as pa

    vectors = pa.array((m / 256).tolist(), pa.list_(pa.float64()))
    block = topk._Block(pa.table({"vec_id": np.arange(4000), "embedding": pa.chunked_array([vectors])}), pivots, 16)
    looked = []
    products = V.products
    monkeypatch.setattr(V, "products", lambda a, b: looked.append(len(b)) or products(a, b))
    for q in range(0, 4000, 97):
        ids, scores = block.search(q, m[q], V.lengths(m[q : q + 1])[0], pivots.table(m[q : q + 1])[0], 5, None)
        every = sorted((-int(s), i) for i, s in enumerate(m @ m[q]) if i != q)[:5]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == every
    assert sum(looked) < 0.25 * 4000 * len(range(0, 4000, 97))


def test_bounds_of_cells_hold_their_rows(spark):
    rows = made_vectors(5, 500, 5, clusters=9)
    m = np.floor(256 * np.array([r[1] for r in rows]))
    pivots = topk.Pivots(m[::3], 12)
    index = topk._index(spark.createDataFrame(rows, VECTORS).select("vec_id", "embedding"), pivots, 5)
    cells = topk.Cells(index, pivots, 5, 100)
    assert cells.n.sum() == 500
    bounds, of = cells.bounds(V.lengths(m), pivots.table(m)), pivots.cells(m)
    assert (bounds[:, of] >= m @ m.T).all()
    assert (bounds < np.median(m @ m.T)).any()


# Prefix trie ----------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute_trie(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            said[conv].append((turn is not None, turn or 0, tie, role, text))
    said = {c: [x[3:] for x in sorted(v)] for c, v in said.items()}
    made = {}
    for c in said:
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        made[c] = said[c] if c == base else said.get(base, [])[:h] + said[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
        ends[tuple(made[c])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        parent = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), parent, len(convs), len(children), len(leaves), saved, digest))
    return sorted(out, key=repr)


def conversations(seed, n, turns, words):
    r = random.Random(seed)
    return [
        (c, t, r.choice(["user", "assistant"]), r.choice(words)) for c in r.sample(range(-n, n), n) for t in range(r.randint(1, turns))
    ]


TRIES = {
    "bushy": conversations(1, 150, 9, ["a", "b"]),
    "few words": conversations(2, 100, 5, ["", "ä", "long text " * 20]),
    "one conversation many times": [(c, t, "user", f"t{t}") for c in range(200) for t in range(6)],
    "nulls and ties": [
        (None, 0, "user", "x"), (1, None, "user", "first"), (1, 2, None, None), (1, 2, "user", "tie"), (1, 2, "user", "tie"),
        (1, 2, "assistant", "tie"), (6, 1, "user", "only"), (9, 0, "a:1", "b"), (9, 1, "a", "1:b"), (14, 0, "", ""), (13, 0, None, None),
    ],
    "turnless": [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7, 8, 9, 11)],
    "deep": [(c, t, "user", str(t % 7)) for c in (0, 1, 5) for t in range(300)],
    "none": [],
}


@pytest.mark.parametrize("name", TRIES)
def test_trie_equals_brute_force(spark, name):
    df = spark.createDataFrame(TRIES[name], TURNS).selectExpr("*", "1 AS node", "2 AS base", "3 AS depth", "4 AS shard")
    got = sorted(map(tuple, prefixtrie.trie(df).collect()), key=repr)
    assert got == brute_trie(TRIES[name])


def test_trie_is_the_same_however_sharded(spark, monkeypatch):
    """Shards of three conversations: hot prefixes and lists of ends go over many shards."""
    rows = TRIES["bushy"] + [(c, t, "user", f"t{t}") for c in range(1000, 1100) for t in range(3)]
    df = spark.createDataFrame(rows, TURNS)
    monkeypatch.setattr(prefixtrie, "SHARD_CONVERSATIONS", 3)
    nodes = prefixtrie._sharded(prefixtrie.rebuilt(prefixtrie.turns_of(df)))
    assert nodes.select("shard").distinct().count() > 50
    got = sorted(map(tuple, prefixtrie._summed(prefixtrie._counted(nodes), nodes).collect()), key=repr)
    assert got == brute_trie(rows)


def test_bits_and_places():
    for places in ([0], [5], [0, 1, 2], [7, 8, 63, 64, 1000]):
        assert prefixtrie._places(prefixtrie._bits(places)) == places
        assert prefixtrie._bits(places).bit_count() == len(places)
