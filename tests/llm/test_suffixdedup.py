import hashlib
import random

import numpy as np

from helixloom.llm import suffixdedup as s


def brute(rows):
    seen, out = [], []
    for key in sorted({k for k, _ in rows}, key=lambda k: (k is not None, k)):
        old, new = {w for x in seen for w in x}, set()
        for text in [t for k, t in rows if k == key]:
            b = (text or "").encode()
            gone = bytearray(len(b))
            for i in range(len(b) - 49):
                if b[i : i + 50] in old:
                    gone[i : i + 50] = b"\1" * 50
                new.add(b[i : i + 50])
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            runs = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
            out.append((key, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
        seen.append(new)
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as version")
    got = s.dedup_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé \n") for _ in range(rng.randrange(1, 9)))
    pool = ["".join(word() for _ in range(40)) for _ in range(12)]
    rows = [(0, "x" * 300), (1, "x" * 120), (2, "ab" * 200), (3, ""), (4, None), (5, "y" * 49), (6, "y" * 50), (7, "y" * 51), (None, pool[0]), (8, pool[0] + "\0" * 60), (9, "\0" * 70)]
    for i in range(40):
        parts = [rng.choice(pool)[rng.randrange(60) :][: rng.randrange(1, 200)] if rng.random() < 0.5 else "".join(word() for _ in range(10)) for _ in range(rng.randrange(1, 6))]
        rows.append((20 + i, "".join(parts)))
    rows.append((70, rows[-1][1]))
    assert run(spark, rows) == brute(rows)


def test_rows_that_share_an_id(spark):
    a, b = "".join(f"{i}," for i in range(60)), "".join(f"{i};" for i in range(60))
    rows = [(5, a), (5, a), (5, b + a[:60]), (6, b), (4, a[20:90])]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_merge_gives_the_order_and_the_common_prefixes():
    rng = np.random.default_rng(0)
    runs, every = [], []
    for k in (0, 1, 7, 30, 5):
        block = rng.integers(97, 99, (k, s.MATCH)).astype(np.uint8)
        block[: k // 2, 3:] = 97
        rows = sorted(bytes(r) for r in block)
        common = [0] + [next((i for i in range(s.MATCH) if a[i] != b[i]), s.MATCH) for a, b in zip(rows, rows[1:], strict=False)]
        runs.append((np.array(common[:k], np.uint8), b"".join(r[c:] for r, c in zip(rows, common, strict=False))))
        every += rows
    order, common = s.merge(runs)
    merged = [every[i] for i in order]
    assert merged == sorted(every)
    assert list(common[1:]) == [next((i for i in range(s.MATCH) if a[i] != b[i]), s.MATCH) for a, b in zip(merged, merged[1:], strict=False)]


def test_hot_grams_dealt_over_all_ranges(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9)))
    pool = ["".join(word() for _ in range(40)) for _ in range(8)]
    rows = [(i, "".join(rng.choice(pool)[rng.randrange(60) :][: rng.randrange(40, 200)] + word() for _ in range(rng.randrange(1, 5)))) for i in range(40)]
    texts = [t.encode() for _, t in rows]
    for share in (1, 3):
        grams = np.array(sorted({t[i : i + s.GRAM] for t in texts for i in range(0, len(t) - s.GRAM)})[::share], f"S{s.GRAM}")
        monkeypatch.setattr(s, "borders", lambda docs, parts, n, grams=grams: (grams[:: len(grams) // 6], grams))
        assert run(spark, rows) == brute(rows)


def test_borders_come_from_a_bounded_sample(spark, monkeypatch):
    """Many rows without an id, and one very long text: few grams reach the driver."""
    seen = []
    monkeypatch.setattr(s.np, "sort", lambda x, sort=np.sort: seen.append(len(x)) or sort(x))
    rows = spark.range(20_000).selectExpr("cast(null as bigint) as doc_id", "repeat(concat('row ', id % 900, ' '), 40) as text")
    cuts, _ = s.borders(rows, 8, 100)
    assert 0 < seen[-1] <= 200 * 40 and len(cuts) > 2
    rng = random.Random(1)
    long = spark.createDataFrame([(1, "".join(rng.choice("abcdef ") for _ in range(300_000)))], "doc_id long, text string")
    s.borders(long, 8, 100)
    assert 0 < seen[-1] <= s.SAMPLE_GRAMS
