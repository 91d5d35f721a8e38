import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixloom.llm import decontam, mixing


def shares(sizes, weights, share, cap):
    """Resharing the excess until none is left, as the contract words it."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, target, opened = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-6 and opened:
        total = sum(w[n] for n in opened)
        add = {n: left * w[n] / total for n in opened}
        left = 0.0
        for n in list(opened):
            target[n] += add[n]
            if target[n] >= cap * sizes[n]:
                left += target[n] - cap * sizes[n]
                target[n] = cap * sizes[n]
                opened.discard(n)
    return target


def test_targets_and_copies(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "B", "é", "z", None, "big", "big", "big"]), " ".join(["w"] * rng.randrange(0, 60))) for i in range(3000)]
    rows += [(3000, "a", None), (3001, "a", ""), (None, "a", "x y"), (7, "a", "x y"), (7, "a", "x y"), (3002, "empty", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"size": F.lit("mine"), "p": F.lit(1)})
    got = mixing.mix(df, chunk_rows=40).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = shares(sizes, (5, 2, 1), 1.5, 2.0)
    for s, part in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert part["source_size"].iloc[0] == sizes[s] and part["target"].iloc[0] == pytest.approx(want[s])
        assert abs(part["taken"].sum() - want[s]) <= 60
        assert (part["taken"] <= 2 * part["size"]).all() and (part["taken"] == part["copies"] * part["size"]).all()
    again = mixing.mix(df.repartition(7), chunk_rows=40).toPandas()
    order = ["doc_id", "source", "size", "copies"]
    assert got.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def test_settle_keeps_the_words_and_the_probabilities():
    rng = random.Random(1)
    size, p = [rng.randrange(1, 40) for _ in range(25)], [rng.random() for _ in range(25)]
    mean = np.zeros(25)
    for seed in range(4000):
        out, rest = mixing.settle(list(range(25)), size, p, seed)
        assert sum(s * x for s, x in zip(size, out, strict=True)) == pytest.approx(sum(s * x for s, x in zip(size, p, strict=True)))
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != rest)
        mean += out
    assert mean / 4000 == pytest.approx(np.array(p), abs=0.05)


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_against_the_textbook():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64) for _ in range(60)]
    texts = [rng.integers(0, 5, rng.integers(0, 25)).astype(np.uint64) for _ in range(60)]
    assert decontam.align(items, texts).tolist() == [smith_waterman(a, b) for a, b in zip(items, texts, strict=True)]


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randrange(12, 60)))) for i in range(30)] + [(30, "tiny"), (31, None), (32, ""), (33, "?!"), (34, "two words")]
    rows, leaks = [], set()
    for d in range(200):
        words = prose(rng.randrange(0, 300))
        if d % 4 == 0:
            i, text = items[rng.randrange(30)]
            copy = text.split()
            if d % 8:
                for _ in range(len(copy) // 8):
                    copy[rng.randrange(len(copy))] = "edited"
            at = rng.randrange(len(words) + 1)
            words[at:at] = " ".join(copy).upper().split() if d % 3 else copy
            leaks.add((d, i))
        rows.append((d, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "tiny,"), (203, "say Two: words now"), (None, items[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (1 << 21, 300):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.passages(df, bench, block_words=blocks).collect()}
        assert got == leaks | {(202, 30), (203, 34), (None, 0)}  # all of them, whatever was edited
    assert decontam.contaminated(df, bench.filter("false")).collect() == []
    assert decontam.contaminated(df.filter("false"), bench).collect() == []


def test_a_part_that_leaked_often_is_found_in_every_document(spark):
    rng = random.Random(4)
    items = {k: [f"i{k}w{j}" for j in range(n)] for k, n in enumerate((40, 24, 60))}
    rows = []
    for d in range(150):
        item = items[d % 3]
        half = item[: len(item) // 2 + 2]
        if d % 2:
            half[rng.randrange(4, len(half))] = "edited"
        if d % 5 == 0:
            half = half[:6]
        rows.append((d, [f"d{d}"] * rng.randrange(9) + half + [f"e{d}"] * rng.randrange(9)))
    best = lambda words, item: min(1.0, smith_waterman(item, words) / (2 * min(len(item), 26)))
    want = {(d, k): s for d, words in rows for k, item in items.items() if (s := best(words, item)) >= 0.5}
    assert 60 < len(want) < 150
    docs = spark.createDataFrame([(d, " ".join(words)) for d, words in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.passages(docs, bench).collect()} == pytest.approx(want)


def test_long_item_is_cut_in_parts(spark):
    words = [f"u{i}" for i in range(1500)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + " ".join(words[900:1000]) + " after"), (2, "before after")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()} == {(1, 1)}


def test_short_items_need_short_documents(spark):
    bench = spark.createDataFrame([(1, "the"), (2, "once upon a time"), (3, "one two three four five six seven eight")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the"), (2, "the long story of the house"), (3, "so once upon a time it was"), (4, "once upon a time " + "word " * 30), (5, "once upon the time again"), (6, "x " * 40 + "one two three four five six")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["mention"] for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1): False, (2, 1): True, (3, 2): False, (4, 2): True, (5, 1): True, (6, 3): False}


def test_a_gram_of_ten_thousand_items_is_no_seed(spark, monkeypatch):
    """Items that begin alike, and a corpus full of that beginning: hits stay few, and slots are looked at in pieces."""
    items = [(i, f"which one of the following is true of a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} k{i} l{i} m{i} n{i}") for i in range(10_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(d, "which one of the following is true of us " * 300) for d in range(20)] + [(90, "so " + items[77][1])], "doc_id long, text string")
    ids, seqs, keys, places = decontam._block(items)
    index, _ = decontam._index(docs, seqs, keys, places, decontam.STRETCH_WORDS)
    lookup, bounds, _, _ = index[decontam.SEED_WORDS]
    common = np.diff(bounds) > 9_000
    assert 0 < common.sum() <= 3  # of the six that all items hold
    sizes = []
    plain = decontam._slots
    monkeypatch.setattr(decontam, "_SLOTS", 50_000)
    raw = np.frombuffer((items[77][1] + " ").encode() * 40, np.uint8)
    token, first = decontam.tokens(raw, np.array([0, len(raw)]))
    found = [f for f in plain(index, token, first) if not sizes.append(len(f[0]))]
    monkeypatch.setattr(decontam, "_SLOTS", 1 << 60)
    whole = list(plain(index, token, first))
    assert len(whole) == 1 and len(found) > 1 and max(sizes) < 110_000
    assert sorted(zip(*(np.concatenate([f[j] for f in found]).tolist() for j in range(3)), strict=True)) == sorted(zip(*(x.tolist() for x in whole[0]), strict=True))
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect() if r["item_id"] == 77} == {(90, 77)}


def test_words_said_again_in_an_item(spark):
    bench = spark.createDataFrame([(1, "row " * 30 + "your boat gently down the stream"), (2, " ".join(["la"] * 60))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 9 + "row " * 28 + "your boat"), (2, "la " * 500), (3, "row row x row row"), (4, "x " * 50)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()} == {(1, 1), (2, 2)}


def test_recall_against_alignments_of_all_pairs(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    seq = lambda text: decontam.tokens(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))[0]
    texts = [(r["doc_id"], seq(r["text"])) for r in docs.collect()]
    texts = [(d, t) for d, t in texts if 0 < len(t) <= 600]
    items = [(r["item_id"], seq(r["text"])) for r in bench.collect()]
    pairs = [(d, i, a, t) for d, t in texts for i, a in items if len(np.intersect1d(a, t)) >= decontam.THRESHOLD * min(len(a), decontam.FULL_WORDS) / 2]
    scores = decontam.align([p[2] for p in pairs], [p[3] for p in pairs])
    want = {(d, i) for (d, i, a, _), s in zip(pairs, scores, strict=True) if s / (2 * min(len(a), decontam.FULL_WORDS)) >= decontam.THRESHOLD}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.passages(docs.filter(F.col("doc_id").isin([d for d, _ in texts])), bench).collect()}
    assert want and len(want & got) >= 0.9 * len(want) and got <= want


def test_repeated_rows_are_taken_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 7)
    rows = [(None, "a", "one two three")] * 50 + [(4, "a", "four words are here")] * 9 + [(i, "b", "w " * (i % 9)) for i in range(10, 90)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), chunk_rows=20).toPandas()
    assert len(got) == len(rows) and (got["copies"] <= 2).all()
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 9


def test_very_long_texts(spark):
    from helixloom.llm import langid, media, quality

    long = " ".join(f"w{i % 977}" for i in range(700_000))
    bench = spark.createDataFrame([(1, " ".join(f"own{i}" for i in range(40)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, long, "a", "en"), (2, f"{long} " + " ".join(f"own{i}" for i in range(40)), "a", "en"), (3, None, "b", "de"), (4, "kurz und gut", "b", "de")], "doc_id long, text string, source string, lang string")
    assert [r["doc_id"] for r in decontam.contaminated(docs, bench).collect()] == [2]
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: 700_000, 2: 700_040, 3: 0, 4: 3}
    assert {r["doc_id"]: r["payload_bytes"] for r in media.digest_texts(docs).collect()} == {d: max(64, -(-len(t or "") // 64) * 64) for d, t in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit(docs)).collect()}[3] == "und"
    assert all(len(r["stats"]) == len(quality.STATISTICS) and all(np.isfinite(r["stats"])) for r in quality.statistics(docs).collect())


def test_few_documents_of_very_unlike_sizes_come_near_their_target(spark):
    rng = random.Random(6)
    rows = [(100 * k + i, f"s{k}", "w " * int(rng.paretovariate(0.7) * 20 % 6000)) for k in range(6) for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 0.02 * part["target"].iloc[0]
    assert (got["taken"] <= 2 * got["size"]).all()


def test_balance_turns_over_what_cancels_the_rest():
    size, before = [5184, 900, 400, 30, 11], [0.4, 0.5, 0.3, 0.6, 0.2]
    want = sum(s * p for s, p in zip(size, before, strict=True))
    after = mixing.balance(size, before, [1.0, 0.0, 0.0, 1.0, 0.0])
    assert abs(sum(s * p for s, p in zip(size, after, strict=True)) - want) < abs(5214 - want)
    assert mixing.balance([5, 5], [0.0, 1.0], [0.0, 1.0]) == [0.0, 1.0]
