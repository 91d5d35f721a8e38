from helixloom.llm import linededup


def brute(rows):
    """The definition, one line at a time, in plain Python."""
    docs = []
    for key, text in sorted(rows):
        seq = [x.strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")]
        docs.append((key, [x for x in seq if x]))
    return docs


def run_of(a, b, i, j):
    left = 0
    while i - left > 0 and j - left > 0 and a[i - left - 1] == b[j - left - 1]:
        left += 1
    right = 0
    while i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
        right += 1
    return range(i - left, i + right)


def test_long_lines_and_runs_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(60))
    a, b, c = "alpha one", "beta two", "gamma three"
    rows = [
        (1, f"{a}\n{b}\n{c}\nown 1"), (2, f"x\n{a}\n\n{b}\n{c}\nown 2"), (3, f"{a}\nother\n{b}"),
        (4, f"{long}\nhead"), (5, f"tail\n{long}"), (6, None), (7, ""), (8, f"{long}\n{long}\nend"),
        (9, "k\nk\nk\nk\nk\nk"), (1, f"{a}\n{b}\n{c}\nown 1"), (None, "free\nline"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_lines", "1 as extra")
    got = {(r["doc_id"], r["text"]): r for r in linededup.dedup_lines(df).collect()}
    texts = {k: v["n_removed"] for k, v in got.items()}
    assert texts[(1, f"{a}\n{b}\n{c}\nown 1")] == 0
    assert texts[(2, "x\n\nown 2")] == 3
    assert texts[(3, f"{a}\nother\n{b}")] == 0
    assert texts[(4, f"{long}\nhead")] == 0 and texts[(5, "tail")] == 1 and texts[(8, "end")] == 2
    assert texts[(9, "k")] == 5
    assert (6, None) in texts and (7, "") in texts and texts[(None, "free\nline")] == 0
    assert len(linededup.dedup_lines(df).collect()) == len(rows)
    assert "extra" in linededup.dedup_lines(df).columns


def test_every_repeated_run_of_three_shares_a_fingerprint(spark):
    import random

    rng = random.Random(3)
    rows = [(i, "\n".join(f"line {rng.randrange(12)}" for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r["doc"]: set(r["lines"]) for r in linededup.repeated(df).collect()}
    docs = brute(rows)
    for n, (key, a) in enumerate(docs):
        for line in removed.get(key, ()):  # what goes has an earlier equal
            assert any(a[line] in b for _, b in docs[:n]) or a[line] in a[:line]
        for m in range(n):  # a document that repeats an earlier one from end to end loses it
            if len(a) >= 3 and a == docs[m][1]:
                assert removed[key] == set(range(len(a)))
    whole = {r["doc_id"]: r["n_lines"] for r in linededup.dedup_lines(df).collect()}
    assert whole == {k: len(a) for k, a in docs}


def whole_rule(rows):
    """Every pair of places, extended both ways: what a run of 3 lines or 50 words deletes."""
    docs = brute(rows)
    gone = {key: set() for key, _ in docs}
    for n, (key, a) in enumerate(docs):
        for m in range(n + 1):
            b = docs[m][1]
            for i in range(len(a)):
                for j in range(i if m == n else len(b)):
                    if a[i] == b[j]:
                        run = run_of(a, b, i, j)
                        if len(run) >= 3 or sum(len(a[x].split()) for x in run) >= 50:
                            gone[key].update(run)
    return {key: lines for key, lines in gone.items() if lines}


def test_removed_lines_are_those_of_the_whole_rule(spark):
    import random

    rng = random.Random(11)
    kinds = [" ".join([f"k{k}"] * n) for k, n in enumerate([2, 3, 4, 5, 20, 25, 28, 30, 45, 49, 50, 60])]
    rows = [(i, "\n".join(rng.choice(kinds) + rng.choice(["", "", "", f" own{i}"]) for _ in range(rng.randrange(0, 9)))) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc"]: set(r["lines"]) for r in linededup.repeated(df).collect()} == whole_rule(rows)


def test_runs_of_two_lines_of_fifty_words(spark):
    half = [" ".join([f"h{k}"] * 26) for k in range(12)]
    rows = [(i, f"head {i}\n{half[2 * i]}\n{half[2 * i + 1]}\ntail {i}") for i in range(6)]
    rows += [(10 + i, f"other {i}\n{half[2 * i]}\n{half[2 * i + 1]}\nend {i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {10 + i: {1, 2} for i in range(6)}
    assert {r["doc"]: set(r["lines"]) for r in linededup.repeated(df).collect()} == want == whole_rule(rows)


def test_run_shared_with_a_second_holder_only(spark):
    rows = [(20, "x\ny\nelse"), (21, "x\ny\nz"), (22, "x\ny\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc"]: set(r["lines"]) for r in linededup.repeated(df).collect()} == {22: {0, 1, 2}} == whole_rule(rows)


def test_texts_are_cut_without_sorting_them_or_leaving_the_jvm(spark):
    # One document of 30,000 lines loses every second run of three; places are counted without the blank lines.
    runs = [[f"r{k} {j}" for j in range(3)] for k in range(5000)]
    own = [[f"own {k} {j}" for j in range(3)] for k in range(5000)]
    rows = [(k, "\n".join(run)) for k, run in enumerate(runs)]
    rows += [(9000, "\n \n".join("\n".join(run) for pair in zip(runs, own, strict=True) for run in pair)), (9001, "\u3000\n\x0b\t\r\n\x1c\n"), (9002, None)]
    found = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r)[1:] for r in found.filter("doc_id > 8999").collect()}
    assert got == {9000: (" \n" + "\n \n \n".join("\n".join(run) for run in own), 30_000, 15_000), 9001: ("\u3000\n\x0b\t\r\n\x1c\n", 2, 0), 9002: (None, 0, 0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and not any(x in plan for x in ("MapInArrow", "SortMergeJoin"))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup_lines(df).collect() == []


def test_equal_windows_have_the_same_fingerprint():
    import numpy as np

    rng = np.random.default_rng(5)
    key = rng.integers(0, 30, 400).astype(np.uint64)
    first = np.array([0, 100, 100, 103, 400])
    least, start, size, code = linededup.windows(key, np.ones(400, int), first)
    where = {}
    for a, s, n, c in zip(least, start, size, code, strict=True):
        assert s <= a < s + n and key[a] == key[s : s + n].min()
        content = tuple(key[s : s + n].tolist())
        assert where.setdefault(content, (a - s, c)) == (a - s, c)
    assert len({c for _, c in where.values()}) == len(where)
    assert sorted(start.tolist()) == [*range(98), 100, *range(103, 398)]


def test_hot_keys_are_joined_apart(spark):
    from helixloom.llm._shared import join_counted

    left = spark.range(3000).selectExpr("if(id % 3 = 0, 7L, id) as k", "id as v")
    counted = left.groupBy("k").count().withColumnRenamed("count", "n").filter("k % 2 = 1")
    got = join_counted(left, counted, ["k"], "n", share=10, least=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(counted, "k").select("k", "v", "n").collect()))
