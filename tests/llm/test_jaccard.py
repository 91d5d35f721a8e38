import random
import re

import pytest

from helixloom.llm import jaccard
from helixloom.llm.components import components


def sets_of(rows, k):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
        out[i] = frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])
    return out


def brute(rows, k, percent):
    sets = sets_of(rows, k)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def texts(seed, lengths, copies):
    rng = random.Random(seed)
    rows = [(100, None), (101, ""), (102, " \t\n"), (103, "One two"), (104, "one  TWO"), (105, "one two three")]
    for n in lengths:
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [f"x{rng.randrange(50)}"] * rng.randrange(2)
            rows.append((200 + len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "lengths"), [(4, 85, [9, 12, 15, 17, 20, 30, 80]), (2, 60, [3, 4, 6, 9, 14, 40])])
def test_components_against_all_pairs(spark, k, percent, lengths):
    rows = texts(k, lengths, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(df, jaccard.Measure(k, percent)).collect()}
    assert got == brute(rows, k, percent)


def test_rows_that_share_an_id_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, a), (2, a), (3, b), (2, b), (None, "own words here and there")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Measure(4, 85)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, None)}


def test_empty_table(spark):
    assert jaccard.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_boundary_follows_cost():
    m = jaccard.Measure(4, 85)
    assert 0 < jaccard.boundary({n: 1 for n in range(1, 65)}, m) < 20
    assert jaccard.boundary({}, m) == 0
    for n in range(1, 40):
        for k in m.partners(n):
            o = m.overlap(n, k)
            assert 100 * o >= 85 * (n + k - o) and 100 * (o - 1) < 85 * (n + k - o + 1)


def test_long_chains_and_stars_are_one_component(spark):
    chain = [(i, i + 1) for i in range(64)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    df = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(65)} | {1000 + i: 1000 for i in range(50)}
