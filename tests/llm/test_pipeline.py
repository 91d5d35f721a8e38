import random
import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from helixloom.llm import linededup
from test_jaccard import brute
from test_linededup import brute as lines_of
from test_linededup import whole_rule

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, size=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def got(df):
    assert df.columns[:5] == [f.split()[0] for f in SCHEMA.split(", ")]
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def with_clash(df):
    return df.withColumns({"score": F.lit("mine"), "lang_pred": F.lit("mine"), "n_lines": F.lit("mine"), "n_removed": F.lit("mine"), "__x": F.lit(1)})


def test_stages_and_last_stage(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "mixing"]


def test_language_stage_keeps_columns_of_the_same_names(spark):
    rng = random.Random(2)
    words = {"en": "the house of water and this that with".split(), "de": "das haus der wasser und dieses mit nicht".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(40)), x, "s", 1) for i, x in enumerate(["en", "de"] * 60)]
    df = spark.createDataFrame([*rows, (900, None, "en", "s", 0), (901, "123 456", "de", "s", 7), (902, "", None, "s", 0), (None, rows[0][1], None, None, None)], SCHEMA)
    out = pipeline.identify_language(spark, with_clash(df), "")
    assert out.columns == with_clash(df).columns
    assert {(r["doc_id"], r["score"], r["n_lines"]) for r in out.collect()} == {(r[0], "mine", "mine") for r in rows} | {(None, "mine", "mine")}


def test_line_stage_against_brute_force(spark):
    rng = random.Random(4)
    kinds = [" ".join([f"k{k}"] * n) for k, n in enumerate([2, 3, 4, 20, 28, 30, 50, 60])]
    rows = [(i, "\n".join(rng.choice(kinds) + rng.choice(["", "", f" own{i}"]) for _ in range(rng.randrange(0, 8)))) for i in range(50)]
    gone = whole_rule(rows)
    want = []
    for (i, text), (_, lines) in zip(rows, lines_of(rows), strict=True):
        kept = [x for n, x in enumerate(lines) if n not in gone.get(i, ())]
        if kept or not lines:
            want.append((i, "\n".join(kept) if lines else text))
    out = pipeline.remove_repeated_lines(spark, with_clash(frame(spark, rows)), "")
    assert got(out) == sorted(want, key=str) and all(r["n_chars"] == len(r["text"]) and r["n_lines"] == "mine" for r in out.collect())
    bare = frame(spark, [*rows, (60, None)]).drop("n_chars")
    assert pipeline.remove_repeated_lines(spark, bare, "").columns == bare.columns


def test_near_duplicate_stage_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for k in range(12):
        base = prose(k, 60).split()
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(60)] = "edit"
            rows.append((len(rows), " ".join(copy)))
    rows += [(100, None), (101, ""), (102, " ")]
    want = sorted(((i, t) for i, t in rows if brute(rows, 5, 80)[i][1] == i), key=str)
    assert got(pipeline.join_near_duplicates(spark, with_clash(frame(spark, rows)), "")) == want


def test_near_duplicate_stage_leaves_unlike_texts_of_one_id(spark):
    a, b, c, d, e = (prose(s, 40) for s in range(20, 25))
    rows = [(None, a), (None, b), (5, c), (5, d), (5, c), (7, d), (8, e), (None, e), (None, None), (None, None), (5, "")]
    out = got(pipeline.join_near_duplicates(spark, frame(spark, rows), ""))
    assert out == sorted([(None, a), (None, b), (5, c), (7, d), (8, e), (None, None), (None, None), (5, "")], key=str)


def test_benchmark_stage_takes_only_rows_with_a_passage(spark, tmp_path):
    item = prose(1, 40)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean, other = prose(2, 50, 10**6), prose(3, 50, 10**6)
    rows = [(1, clean), (1, f"{clean} {item}"), (None, other), (None, item), (2, f"{item} {other}"), (3, None)]
    out = pipeline.remove_benchmark_passages(spark, with_clash(frame(spark, rows)), str(tmp_path))
    assert got(out) == sorted([(1, clean), (None, other), (3, None)], key=str)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == [], name


def test_whole_run(spark):
    sf = "/root/testdata/sf0.001"
    out = pipeline.run(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert out["doc_id"].is_unique and set(out["doc_id"]) <= set(docs["doc_id"]) and 0 < len(out) < len(docs)
    assert (out["taken"] == out["copies"] * out["size"]).all() and (out["copies"] <= 2).all()
    assert not re.search("nan", " ".join(out.columns))
