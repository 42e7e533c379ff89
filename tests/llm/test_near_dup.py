import random
from collections import defaultdict

import numpy as np
import pytest

from marlstone.llm import common, minhash, near_dup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").translate(UP).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    index = defaultdict(list)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        n = defaultdict(int)
        for g in s:
            for j in index[g]:
                n[j] += 1
            index[g].append(i)
        for j, k in n.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d, d == (low.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str)


def check(df):
    got = near_dup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_against_brute_force(request, table):
    check(request.getfixturevalue(table))


def chain(seed, n, edits):
    """Copies of one text, each with other words changed; many are linked through others alone."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(edits):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("hot", [1, 20])
def test_keys_are_joined_both_ways(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, id % 50) k")
    keys = rows.groupBy("k").count().where("k != 7").selectExpr("k", "`count` n", "k * 10 as t")
    got = common.join_keys(rows, keys, "k", "n").select("id", "k", "t").collect()
    want = [(i, k, k * 10) for i in range(1000) if (k := 0 if i % 3 == 0 else i % 50) != 7]
    assert sorted(map(tuple, got)) == want
    assert not common.join_keys(rows, keys.where("k < 0"), "k", "n").count()


@pytest.mark.parametrize("task_edges", [50_000, 40])
def test_components(spark, monkeypatch, task_edges):
    from marlstone.llm import components

    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 300, 2)] + [(i, i + 7) for i in range(400, 600)] + [(1000, 1000 + r.randrange(1, 90)) for _ in range(80)] + [(2**62, 5), (2**62, 2**62 + 1)]
    r.shuffle(edges)
    sets = components.UnionFind()
    for a, b in edges:
        sets.union(a, b)
    df = spark.createDataFrame(edges, "u long, v long").repartition(6)
    assert sorted(map(tuple, components.components(df).collect())) == sorted((u, sets.find(u)) for u in {x for e in edges for x in e} if sets.find(u) != u)
    assert components.components(df.limit(0)).count() == 0


def test_large_groups_without_a_centre(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 2000)
    texts = chain(1, 150, 3) + chain(2, 80, 5) + chain(3, 30, 1) * 3
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))


def test_null_ids_join_classes(spark):
    t = " ".join(f"word{i}" for i in range(40))
    rows = [(None, t), (7, t + " end"), (5, t), (None, "only rows without an id have this text"), (3, "a b"), (3, "a b"), (9, "a  B")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(None, 5, False), (7, 5, False), (5, 5, True), (None, None, True), (3, 3, True), (3, 3, True), (9, 3, False)], key=str)


def test_signatures_are_superminhash():
    slots, r = 32, np.random.default_rng(0)
    for n in (1, 3, 40, 500):
        e = r.integers(0, 2**63, n).astype(np.uint64)
        want = np.full(slots, np.inf)
        for x in e:
            p = list(range(slots))
            for j in range(slots):
                with np.errstate(over="ignore"):
                    h = int(minhash.mix(np.array([x + minhash.GOLDEN * np.uint64(j + 1)]))[0])
                k = j + ((h & 0xFFFFFFFF) * (slots - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j + (h >> 32) / 2**32)
        got = minhash.signatures(np.concatenate([e, e[:1]]), np.array([0] * n + [1]), 3, slots)
        assert np.array_equal(got[0], want) and np.isinf(got[2]).all()
