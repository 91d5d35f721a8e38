import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from helixloom.llm import langid, quality

WORDS = {
    "en": "the of and to in that was for with this from have which".split(),
    "de": "der die und das nicht von mit sich auf eine ist auch für".split(),
    "fr": "le la les des une que dans est pour qui pas avec être".split(),
    "es": "el los las que una por con para del como más pero está".split(),
    "eo": "kaj estas la de en kiu tiu por sed ankaŭ ĝi ĉiu povas".split(),
}


def docs(spark, n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang, "s"))
    rows += [(n, None, "en", "s"), (n + 1, "", "en", "s"), (n + 2, "12 34 !!", "en", "s"), (n + 3, "…—", "de", "s"), (n + 4, rows[0][1], None, None), (None, rows[0][1], "en", "s"), (n + 5, "é", "fr", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("mine"))


def test_families_then_languages(spark):
    df = docs(spark)
    model = langid.fit(df.filter(langid.fold(3) != 1))
    assert set(model.families) == {"germanic", "romance", "eo"}
    rows = langid.identify(df, model, ["doc_id", "lang", "text"]).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    of = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [of[400 + i] for i in range(4)] == ["und"] * 4
    assert of[404] == of[0] and of[405] != "und"


def test_no_labels_and_no_rows(spark):
    df = docs(spark, 5)
    assert langid.fit(df.filter("lang = 'xx'")) is None
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(df.filter("false"), None).collect() == []


def test_fold_is_crc32_of_the_id(spark):
    got = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", langid.fold(3).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in got)


def test_quality_separates_junk(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    good = lambda: ". ".join(" ".join(word() for _ in range(12)) for _ in range(6))
    bad = lambda: rng.choice([" ".join(word().upper() + "!!" for _ in range(30)), "spam spam " * 30, " | ".join(word() for _ in range(30))])
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(900)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5, None), (None, 1)], "doc_id long, quality int")
    measured = quality.statistics(df)
    known = quality.labelled(measured, labels).cache()
    model = quality.fit(known.filter("doc_id % 4 < 2"), known.filter("doc_id % 4 = 3"), features=64)
    got = {r["doc_id"]: r["score"] for r in quality.score(measured, model).collect()}
    assert len(got) == 903 and all(0 <= v <= 1 for v in got.values())
    held = [(got[i], y) for i, _, y in rows if i % 4 == 2]
    assert np.mean([(s >= 0.7) == bool(y) for s, y in held]) > 0.95
    assert quality.fit(known.filter("false"), known) is None
    assert {r["score"] for r in quality.score(measured, None).collect()} == {0.5}


def test_isotonic_never_falls():
    at, mean = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([1.0, 0.0, 2.0, 4.0]), np.array([1.0, 1.0, 4.0, 4.0]))
    assert (np.diff(mean) >= 0).all() and mean[-1] == 1.0 and at[0] == 0.0 and mean[0] == 0.5


def test_statistics_of_each_row_do_not_depend_on_its_neighbours(spark):
    texts = ["A b! c|d\n\nA b! c|d", "", "é" * 50, "word " * 400, "1 2 3"]
    alone = [quality.measure(*_one([t]))[0] for t in texts]
    together = quality.measure(*_one(texts))
    assert np.allclose(alone, together)


def _one(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
