"""Queries that run their operators over all rows, with the settings of an unconfigured run."""

import numpy as np
from pyspark.sql import functions as F

from helixloom.operators import sampler
from helixloom.options import Options
from helixloom.plans import queries, synthetic

SMALL = "/root/testdata/sf0.001"


def test_gibbs_gets_every_match_and_the_default_chain(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(sampler, "estimate", lambda classes, survivors, options, total: seen.update(classes=classes, options=options) or spark.createDataFrame([], sampler.ESTIMATES))
    queries.q23_gibbs(spark, SMALL)
    assert seen["options"] == Options()
    found = seen["classes"].agg(F.sum(F.size("cands") * F.col("n")).alias("matches"), F.sum("n").alias("fragments")).first()
    want = queries._weights(spark, SMALL).agg(F.count(F.lit(1)), F.countDistinct("locus_id", "arrival")).first()
    assert tuple(found) == tuple(want)


def test_single_fragments_are_drawn_as_a_class_of_several():
    matrix = np.array([[0.7, 0.2, 0.1], [0.0, 1.0, 0.0], [0.1, 0.0, 0.9]])
    n = np.array([30, 12, 20])
    apart = np.repeat(matrix, n, axis=0)
    runs = [sampler.sample(m, k, 1.0, 200, 20000, np.random.default_rng(2), pi=0.5) for m, k in ((matrix, n), (apart, np.ones(len(apart), np.int64)))]
    assert np.allclose(runs[0][0] / 20000, runs[1][0] / 20000, atol=0.03)
    assert np.allclose(runs[0][1], runs[1][1], atol=0.01)


def assembled_with(monkeypatch, query, spark):
    seen = {}
    real = queries.assemble

    def held(alignments, graph_table, segments, path_rows, options):
        seen.update(options=options, loci=graph_table.count())
        return real(alignments, graph_table, segments, path_rows, options)

    monkeypatch.setattr(queries, "assemble", held)
    return query(spark, SMALL), seen


def test_the_whole_run_has_the_default_settings(spark, monkeypatch):
    _, seen = assembled_with(monkeypatch, queries.q26_assembly, spark)
    assert seen["options"] == Options(min_training_length=800)


def test_single_loci_come_from_a_run_over_all(spark, monkeypatch):
    found, seen = assembled_with(monkeypatch, queries.q27_assembly_single, spark)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    assert seen["loci"] == lines.select("l_suppkey").distinct().count()
    lines.createOrReplaceTempView("lines_of_q27")
    want = spark.sql("""
        WITH u AS (SELECT DISTINCT l_suppkey, (l_partkey * 37 + l_orderkey) % 650 AS t, 100 + int(l_quantity) AS len FROM lines_of_q27 WHERE l_suppkey % 3 <> 0)
        SELECT 'g' || l_suppkey AS gene_id, 4 AS n_exons, 800 AS length, 1.0D AS confidence, double(count(*)) AS expected_count
        FROM u GROUP BY l_suppkey HAVING count(*) >= 12 AND bool_or(t < 200) AND bool_or(t + len > 600)""")
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, want.collect())) and rows


def shifted_by(spark, tmp_path, by):
    """Order lines whose odd suppliers have keys larger by ``by``."""
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    lines.withColumn("l_suppkey", F.col("l_suppkey") + F.when(F.col("l_suppkey") % 2 == 1, by).otherwise(0)).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def of_large_keys(spark, tmp_path, query, *columns):
    """Sorted rows of a query for suppliers whose keys are moved by 359,910, and those of the keys as they are; both are multiples of 3, 5 and 10."""
    found = query(spark, shifted_by(spark, tmp_path, 359_910)).select(*columns).collect()
    return sorted(map(tuple, found)), sorted(map(tuple, query(spark, SMALL).select(*columns).collect()))


def test_status_of_suppliers_beyond_the_positions_of_a_reference(spark, tmp_path):
    found, want = of_large_keys(spark, tmp_path, queries.q25_status, "return_code", "n")
    assert found == want and found


def test_reads_of_large_keys_lie_in_their_loci(spark, tmp_path):
    lines = spark.read.parquet(f"{shifted_by(spark, tmp_path, 359_910)}/lineitem.parquet")
    graph_table, segments, _ = synthetic.splice_graphs(lines)
    ends = graph_table.groupBy("ref").agg(F.max("right").alias("right"))
    assert ends.agg(F.max("right")).first()[0] < 2**31 and graph_table.filter("ref LIKE 'chr_.1'").count() > 0
    reads = synthetic.alignments(lines)
    inside = reads.join(graph_table, (reads["ref"] == graph_table["ref"]) & (reads["pos"] + 1).between(graph_table["left"], graph_table["right"])).count()
    assert inside == reads.count() > 0


def test_empirical_lengths_of_large_keys(spark, tmp_path):
    found, want = of_large_keys(spark, tmp_path, queries.q37_empirical_lengths, "expected_count", "effective")
    assert found == want and found
