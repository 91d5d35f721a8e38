"""Queries that apply each operator to the order and event tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixloom import sinks
from helixloom.functions import cigar, intervals, matching
from helixloom.operators import dedup, fragments, graphs, lengths, likelihood, paths, sampler
from helixloom.options import Options
from helixloom.plans import synthetic
from helixloom.plans.assembly import assemble
from helixloom.sources import alignments, bam, instances
from helixloom.sources.lengths import read_lengths
from helixloom.streaming import duplicates
from helixloom.tables import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _single(path_rows: DataFrame, segments: DataFrame) -> DataFrame:
    return graphs.single_path(graphs.junctions(path_rows, graphs.kept_segments(segments))).filter("single_path").select(F.col("graph_id").alias("subgraph"))


def _op(op: str, n) -> Column:
    return F.struct(F.lit(op).alias("op"), (n if not isinstance(n, int) else F.lit(n)).cast("int").alias("len"))


_ALL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("""
WITH p AS (SELECT *, l_suppkey % 5 AS ref, (l_partkey % 400)::int AS pos1, (l_quantity::int % 5)::int AS ins, (1 + l_partkey % 3)::int AS nh,
  CASE l_linenumber % 3 WHEN 0 THEN '10M10M' WHEN 1 THEN '10M1M10M' ELSE '20M' END AS cigar FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY ref, pos1, ins, cigar ORDER BY nh <> 1, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k FROM p)
SELECT ref, pos1, ins, cigar, nh, l_orderkey FROM r WHERE k = 1
""")
def q01_dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    shape = F.when(F.col("l_linenumber") % 3 == 0, F.array(_op("M", 10), _op("I", 1), _op("M", 10))).when(F.col("l_linenumber") % 3 == 1, F.array(_op("M", 10), _op("D", 1), _op("M", 10))).otherwise(F.array(_op("M", 20)))
    pos, ins, nh = (F.col("l_partkey") % 400).cast("int"), (F.col("l_quantity").cast("int") % 5).cast("int"), (1 + F.col("l_partkey") % 3).cast("int")
    a = F.struct(pos.alias("pos"), ins.alias("insert_size"), shape.alias("cigar"))
    b = F.struct(pos.alias("pos"), shape.alias("cigar"), nh.alias("nh"), F.struct(*_ALL).alias("arrival"))
    pairs = rows.select((F.col("l_suppkey") % 5).alias("ref"), F.lit(".").alias("bucket"), "l_orderkey", a.alias("a"), b.alias("b"))
    kept = dedup.collapse_duplicates(pairs, ["ref", "bucket"])
    return kept.select("ref", F.col("a.pos").alias("pos1"), F.col("a.insert_size").alias("ins"), cigar.normalised(F.col("a.cigar")).alias("cigar"), F.col("b.nh").alias("nh"), "l_orderkey")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_suppkey") % 5).alias("ref"), (c("l_partkey") % 5).alias("mate_ref"), c("l_quantity").cast("int").alias("pos"), F.lit(25).alias("mate_pos"), (c("l_partkey") * 900).alias("insert_size"),
        (c("l_partkey") % 4 != 0).alias("is_mapped"), (c("l_linenumber") < 5).alias("is_primary"), (c("l_suppkey") % 7 != 0).alias("mate_mapped"), (c("l_linenumber") % 2 == 1).alias("is_first"), (c("l_returnflag") == "R").alias("is_rev"), (c("l_linestatus") == "O").alias("mate_rev"),
    )


_RECORDS = "SELECT l_suppkey % 5 AS ref, l_partkey % 5 AS mate_ref, l_quantity::int AS pos, 25 AS mate_pos, l_partkey * 900 AS insert_size, l_linenumber % 2 = 1 AS is_first, l_returnflag = 'R' AS is_rev, l_linestatus = 'O' AS mate_rev FROM lineitem WHERE l_partkey % 4 <> 0 AND l_linenumber < 5 AND l_suppkey % 7 <> 0"


@query(f"""
SELECT ref, count(*) AS mapped, count(*) FILTER (WHERE is_rev <> mate_rev AND ref = mate_ref AND abs(insert_size) <= 700000) AS proper FROM ({_RECORDS}) GROUP BY ref
""")
def q02_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = dedup.mapped(_records(spark, sf_dir))
    good = dedup.proper(records).groupBy("ref").agg(F.count(F.lit(1)).alias("proper"))
    return records.groupBy("ref").agg(F.count(F.lit(1)).alias("mapped")).join(good, "ref", "left").select("ref", "mapped", F.coalesce("proper", F.lit(0).cast("long")).alias("proper"))


@query(f"""
WITH r AS ({_RECORDS}),
s AS (SELECT ref, CASE WHEN (is_first AND is_rev AND pos >= mate_pos) OR (NOT is_first AND NOT is_rev AND pos <= mate_pos) THEN '+'
  WHEN (is_first AND NOT is_rev AND pos <= mate_pos) OR (NOT is_first AND is_rev AND pos >= mate_pos) THEN '-' END AS bucket FROM r)
SELECT ref, bucket AS first_bucket, CASE bucket WHEN '+' THEN '-' WHEN '-' THEN '+' END AS second_bucket, count(*) AS n FROM s GROUP BY ALL
""")
def q03_strand_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = dedup.mapped(_records(spark, sf_dir))
    both = records.select("ref", dedup.strand_bucket(Options(strand="first")).alias("first_bucket"), dedup.strand_bucket(Options(strand="second")).alias("second_bucket"))
    return both.groupBy("ref", "first_bucket", "second_bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT *, event_id // 2 AS name, (event_id % 2 * 7)::int AS pos FROM events WHERE event_type <> 'click')
SELECT a.name::varchar AS name, a.event_id AS first_id, b.event_id AS second_id, a.pos AS pos1, b.pos AS pos2 FROM e a JOIN e b ON a.name = b.name AND a.event_id < b.event_id
""")
def q04_mate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("event_id") % 2
    records = table(spark, sf_dir, "events").filter("event_type != 'click'").select(
        F.lit("r").alias("ref"), F.floor(F.col("event_id") / 2).cast("string").alias("name"), F.lit(None).cast("int").alias("hi"), F.col("event_id").alias("arrival"), (odd * 7).cast("int").alias("pos"), ((1 - odd) * 7).cast("int").alias("mate_pos"),
        F.array(_op("M", 5)).alias("cigar"), F.lit(0).alias("insert_size"), F.lit("").alias("qual"), F.lit("").alias("md"), F.lit(1).alias("nh"),
    )
    return dedup.pair_mates(records, ["ref"]).select("name", F.col("a.arrival").alias("first_id"), F.col("b.arrival").alias("second_id"), F.col("a.pos").alias("pos1"), F.col("b.pos").alias("pos2"))


@query("""
WITH p AS (SELECT l_suppkey % 5 AS ref, l_returnflag = 'R' AS strand, ((l_partkey % 2000) * 10)::int AS left_end, ((l_partkey % 2000) * 10 + l_quantity::int)::int AS right_end, l_orderkey, l_linenumber FROM lineitem),
f AS (SELECT *, CASE WHEN left_end <= max(right_end) OVER (PARTITION BY ref, strand ORDER BY left_end, right_end, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM p),
i AS (SELECT *, sum(o) OVER (PARTITION BY ref, strand ORDER BY left_end, right_end, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT ref, strand, min(left_end) AS left_end, max(right_end) AS right_end, count(*) AS n FROM i GROUP BY ref, strand, island
""")
def q05_collapse_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ((F.col("l_partkey") % 2000) * 10).cast("int")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("ref"), (F.col("l_returnflag") == "R").alias("strand"), left.alias("left_end"), (left + F.col("l_quantity").cast("int")).cast("int").alias("right_end"), "l_orderkey", "l_linenumber")
    numbered = intervals.islands(rows, ["ref", "strand"], "left_end", "right_end", ["right_end", "l_orderkey", "l_linenumber"])
    return numbered.groupBy("ref", "strand", "island").agg(F.min("left_end").alias("left_end"), F.max("right_end").alias("right_end"), F.count(F.lit(1)).alias("n")).drop("island")


@query("""
WITH r AS (SELECT DISTINCT l_suppkey % 5 AS ref, (l_partkey - l_partkey % 100)::int AS left_end FROM lineitem WHERE l_linenumber = 1)
SELECT r.ref, r.left_end, count(*) AS n, sum(l.l_partkey)::bigint AS total FROM r JOIN lineitem l ON l.l_suppkey % 5 = r.ref AND l.l_partkey BETWEEN r.left_end AND r.left_end + 30 GROUP BY ALL
""")
def q06_region_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("ref", F.col("l_suppkey") % 5)
    left = (F.col("l_partkey") - F.col("l_partkey") % 100).cast("int")
    regions = rows.filter("l_linenumber = 1").select("ref", left.alias("left_end")).distinct().withColumn("right_end", F.col("left_end") + 30)
    found = intervals.in_range(rows.select("ref", "l_partkey"), regions, ["ref"], "l_partkey", "left_end", "right_end", width=64)
    return found.groupBy("ref", "left_end").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("total"))


def _path_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    flags = F.array(*[F.max(F.when(F.col("event_id") % 6 == i, 1).otherwise(0)) for i in range(6)])
    rows = events.groupBy("user_id").agg(flags.alias("flags"), F.count(F.lit(1)).alias("n")).select((F.col("user_id") % 20).cast("string").alias("graph_id"), F.col("user_id").cast("int").alias("row"), "flags", "n")
    segments = rows.select("graph_id").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(5))))
    segments = segments.withColumn("zero_frac", F.when((F.col("graph_id").cast("int") + F.col("idx")) % 4 == 0, 0.96).otherwise(0.95))
    return rows, graphs.kept_segments(segments)


_JUNCTIONS = """
u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
f AS (SELECT DISTINCT (e.user_id % 20)::varchar AS graph_id, e.user_id, u.n, (e.event_id % 6)::int AS idx FROM events e JOIN u USING (user_id)),
k AS (SELECT * FROM f WHERE (graph_id::int + idx) % 4 <> 0),
s AS (SELECT *, lead(idx) OVER (PARTITION BY graph_id, user_id ORDER BY idx) AS dst FROM k),
j AS (SELECT graph_id, idx AS src, dst, sum(n)::bigint AS coverage FROM s WHERE dst IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_JUNCTIONS} SELECT * FROM j")
def q07_junction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.junctions(*_path_rows(spark, sf_dir))


@query(f"""
WITH {_JUNCTIONS},
d AS (SELECT graph_id, count(DISTINCT dst) AS d FROM j GROUP BY graph_id, src UNION ALL SELECT graph_id, count(DISTINCT src) FROM j GROUP BY graph_id, dst)
SELECT graph_id, max(d) <= 1 AS single_path FROM d GROUP BY graph_id
""")
def q08_single_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.single_path(graphs.junctions(*_path_rows(spark, sf_dir)))


@query("SELECT p_size, count(*) AS n FROM part WHERE 0.05::double <= 1 - (p_partkey % 101) / 100.0::double GROUP BY p_size")
def q09_segment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("zero_frac", (F.col("p_partkey") % 101) / F.lit(100.0))
    return graphs.kept_segments(parts).groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))


def _dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = (F.col("l_partkey") % 12).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 3).cast("string").alias("graph_id"), src.alias("src"), (src + 1 + F.col("l_suppkey") % 3).cast("int").alias("dst")).agg(F.count(F.lit(1)).alias("coverage"))


def _paths(edges: DataFrame, most: int) -> DataFrame:
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("idx")).distinct()
    segments = ends.select("graph_id", "idx", (F.col("idx") * 10 + 1).cast("int").alias("start"), (F.col("idx") * 10 + 5).cast("int").alias("end"))
    bounds = segments.groupBy("graph_id").agg(F.min("start").alias("left"), F.max("end").alias("right"))
    found = paths.candidates(bounds, segments, edges, most=most, pre_mrna=False)
    return found.select(F.col("subgraph").alias("graph_id"), F.array_join(F.transform("path", lambda v: v.cast("string")), ">").alias("path"), "length")


_DAG = "dag AS (SELECT (l_linenumber % 3)::varchar AS graph_id, (l_partkey % 12)::int AS src, (l_partkey % 12 + 1 + l_suppkey % 3)::int AS dst, count(*) AS coverage FROM lineitem GROUP BY ALL)"
_WALK = """
v AS (SELECT graph_id, src AS v FROM e UNION SELECT graph_id, dst FROM e),
w AS (SELECT graph_id, v, v::varchar AS path, 5 AS length FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = v.graph_id AND e.dst = v.v)
  UNION ALL SELECT w.graph_id, e.dst, w.path || '>' || e.dst::varchar, w.length + 5 FROM w JOIN e ON e.graph_id = w.graph_id AND e.src = w.v)
SELECT graph_id, path, length::int AS length FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = w.graph_id AND e.src = w.v)"""


@query(f"WITH RECURSIVE {_DAG}, e AS (SELECT * FROM dag), {_WALK}")
def q10_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(_dag(spark, sf_dir), 100_000)


@query(f"""
WITH RECURSIVE {_DAG},
t AS (SELECT DISTINCT graph_id, 1::bigint AS t FROM dag UNION SELECT graph_id, coverage + 1 FROM dag),
v AS (SELECT graph_id, src AS v FROM dag UNION SELECT graph_id, dst FROM dag),
tv AS (SELECT graph_id, t, v FROM t JOIN v USING (graph_id)),
e AS (SELECT d.graph_id, t, src, dst FROM t JOIN dag d ON d.graph_id = t.graph_id AND coverage >= t),
w AS (SELECT graph_id, t, v, [v] AS path FROM tv WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = tv.graph_id AND e.t = tv.t AND e.dst = tv.v)
  UNION ALL SELECT w.graph_id, w.t, e.dst, list_append(w.path, e.dst) FROM w JOIN e ON e.graph_id = w.graph_id AND e.t = w.t AND e.src = w.v),
p AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = w.graph_id AND e.t = w.t AND e.src = w.v)),
n AS (SELECT graph_id, t, count(*) AS n FROM p GROUP BY ALL),
pick AS (SELECT graph_id, coalesce(min(t) FILTER (WHERE n <= 100), max(t)) AS t FROM n GROUP BY graph_id),
r AS (SELECT graph_id, path, row_number() OVER (PARTITION BY graph_id ORDER BY path) AS k FROM p JOIN pick USING (graph_id, t))
SELECT graph_id, array_to_string(path, '>') AS path, (5 * len(path))::int AS length FROM r WHERE k <= 100
""")
def q11_paths_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 100 paths of a graph: edges go from the least coverage on."""
    return _paths(_dag(spark, sf_dir), 100)


@query("""
WITH s AS (SELECT DISTINCT l_suppkey, l_linenumber * 100 + 1 AS s, l_linenumber * 100 + CASE WHEN (l_suppkey + l_linenumber) % 3 = 0 THEN 60 ELSE 100 END AS e FROM lineitem),
o AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY l_suppkey ORDER BY s) + 1 = s THEN 0 ELSE 1 END AS opens FROM s),
i AS (SELECT *, sum(opens) OVER (PARTITION BY l_suppkey ORDER BY s) AS island FROM o),
x AS (SELECT l_suppkey, min(s) AS s, max(e) AS e FROM i GROUP BY l_suppkey, island)
SELECT l_suppkey, count(*)::int AS n_exons, sum(e - s + 1)::int AS length, string_agg(s::varchar || '-' || e::varchar, ',' ORDER BY s) AS exons FROM x GROUP BY l_suppkey
""")
def q12_exon_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_linenumber") * 100
    end = at + F.when((F.col("l_suppkey") + F.col("l_linenumber")) % 3 == 0, 60).otherwise(100)
    chain = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set(F.struct((at + 1).cast("int").alias("start"), end.cast("int").alias("end")))).alias("segments"))
    exons = chain.withColumn("exons", matching.merge_abutting(F.col("segments")))
    shown = F.array_join(F.transform("exons", lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))), ",")
    return exons.select("l_suppkey", F.size("exons").alias("n_exons"), matching.chain_length(F.col("exons")).alias("length"), shown.alias("exons"))


@query("""
WITH r AS (SELECT DISTINCT (l_suppkey % 50 * 20)::int AS s, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 1 THEN 4 * l_linenumber ELSE 10 + l_linenumber * 5 END AS a FROM lineitem),
x AS (SELECT k::int AS k, 100 * k + 1 AS es, 100 * k + 60 AS ee FROM range(10) t(k)),
f AS (SELECT r.*, x.k, x.ee FROM r JOIN x ON s + 1 BETWEEN es AND ee)
SELECT s, n, k AS first_exon, k AS last_exon, (s + a)::int AS read_end FROM f WHERE n % 2 = 1 AND s + a <= ee
UNION ALL SELECT s, n, k, k + 1, (s + a + 50)::int FROM f WHERE n % 2 = 0 AND s + a = ee AND k < 9
""")
def q13_block_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50 * 20).cast("int").alias("s"), F.col("l_linenumber").alias("n")).distinct()
    spliced = F.array(_op("M", 10 + F.col("n") * 5), _op("N", 40), _op("M", 10))
    shape = F.when(F.col("n") % 2 == 1, F.array(_op("M", F.col("n") * 4))).otherwise(spliced)
    exons = F.array(*[F.struct(F.lit(100 * k + 1).alias("start"), F.lit(100 * k + 60).alias("end")) for k in range(10)])
    placed = matching.held(reads, "r", matching.place_read(F.col("s"), shape, exons, F.lit(0)))
    return placed.filter("r.ok").select("s", "n", F.col("r.first").alias("first_exon"), F.col("r.last").alias("last_exon"), F.col("r.end").alias("read_end"))


@query("""
WITH r AS (SELECT DISTINCT l_linenumber AS n, (l_suppkey % 9)::int AS a, (l_partkey % 7)::int AS b FROM lineitem),
e AS (SELECT *, power(10.0::double, -(20 + a) / 10.0::double) AS e FROM r)
SELECT n, a, b, round((n + a + b + 1) * ln(1 - e) + ln(e / 3), 6) AS log_p FROM e
""")
def q14_read_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 9).cast("int").alias("a"), (F.col("l_partkey") % 7).cast("int").alias("b")).distinct()
    text = lambda c: c.cast("string")
    md = F.concat(text(F.col("n")), F.lit("A"), text(F.col("a")), F.lit("^AC"), text(F.col("b") + 1))
    shape = F.array(_op("M", F.col("n") + 1 + F.col("a")), _op("D", 2), _op("M", F.col("b") + 1))
    qual = F.rpad(F.char(F.col("a") + 53), F.col("n") + F.col("a") + F.col("b") + 2, F.char(F.col("a") + 53))
    return rows.select("n", "a", "b", F.round(cigar.log_probability(shape, md, qual), 6).alias("log_p"))


@query("""
WITH f AS (SELECT user_id, event_id, (event_id % 6)::int AS first_exon, (event_id % 6 + user_id % 2)::int AS last_exon FROM events),
g AS (SELECT *, coalesce(first_exon > max(last_exon) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gap FROM f),
x AS (SELECT user_id, bool_or(gap) AS gap, min(first_exon) AS lo, max(last_exon) AS hi FROM g GROUP BY user_id),
r AS (SELECT user_id::varchar AS locus_id, CASE WHEN gap THEN 'gap' WHEN lo > 0 THEN 'upstream' WHEN hi < 5 THEN 'downstream' END AS reason FROM x)
SELECT * FROM r WHERE reason IS NOT NULL
""")
def q15_coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (F.col("event_id") % 6).cast("int")
    found = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("locus_id"), F.lit(0).alias("cand_idx"), F.col("event_id").alias("arrival"), first.alias("first_exon"), (first + F.col("user_id") % 2).cast("int").alias("last_exon"))
    chain = F.array(*[F.struct(F.lit(i * 10 + 1).alias("start"), F.lit(i * 10 + 5).alias("end")) for i in range(6)])
    found_for = found.select("locus_id").distinct().select("locus_id", F.lit(0).alias("cand_idx"), F.lit(False).alias("is_pre_mrna"), chain.alias("exons"))
    return fragments.exclusions(found, found_for).select("locus_id", "reason")


@query("SELECT l_quantity::int AS length, count(*) AS n FROM lineitem GROUP BY 1")
def q16_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("frag_len")))


@query("""
WITH x AS (SELECT trunc(l_extendedprice / 100) AS x FROM lineitem), m AS (SELECT median(x) AS m FROM x)
SELECT m AS median, (SELECT median(abs(x - m)) FROM x) AS mad, (SELECT count(*) FROM x) AS n FROM m
""")
def q17_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 100).cast("double").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([lengths.median_mad(counts)], "median double, mad double, n long")


_MODEL = """
x AS (SELECT 100 + l_quantity::int AS x FROM lineitem),
m AS (SELECT median(x) AS mean FROM x),
g AS (SELECT mean, 1.4826::double * (SELECT median(abs(x - mean)) FROM x, m) AS sd FROM m),
p AS (SELECT l::int AS length, exp(-power(l - mean, 2) / (2 * sd * sd)) / (sd * sqrt(2 * pi())) AS pmf FROM g, range(1, 601) t(l)),
f AS (SELECT *, sum(pmf) OVER (ORDER BY length) AS cumulated FROM p),
effective AS (SELECT length, cumulated, sum(cumulated) OVER (ORDER BY length) AS effective FROM f)"""


def _model(spark: SparkSession, sf_dir: str) -> tuple[float, float]:
    counts = lengths.histogram(table(spark, sf_dir, "lineitem").select((F.lit(100) + F.col("l_quantity").cast("int")).alias("frag_len")))
    return lengths.gaussian(counts, Options(min_observations=1))


@query(f"""
WITH {_MODEL}
SELECT p_partkey, 10 * p_size AS length, round(cumulated, 8) AS cumulated, round(effective, 6) AS effective FROM part JOIN effective ON length = 10 * p_size
""")
def q18_effective_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective lengths of the parts under the length model of the order lines."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10).alias("length"))
    found = lengths.effective_lengths(spark, 600, *_model(spark, sf_dir))
    return parts.join(found, "length").select("p_partkey", "length", F.round("cumulated", 8).alias("cumulated"), F.round("effective", 6).alias("effective"))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).cast("string").alias("locus_id"), F.col("l_orderkey").alias("arrival"), (F.col("l_suppkey") % 4).cast("int").alias("cand_idx")).agg(F.sum(F.col("l_quantity").cast("long")).alias("w"))
    return likelihood.normalise(rows.withColumn("log_lik", F.log("w")), ["locus_id", "arrival"])


_WEIGHTS = """
w AS (SELECT (l_orderkey % 50)::varchar AS locus_id, l_orderkey AS arrival, (l_suppkey % 4)::int AS cand_idx, sum(l_quantity::bigint)::double AS w FROM lineitem GROUP BY ALL),
p AS (SELECT locus_id, arrival, cand_idx, w / sum(w) OVER (PARTITION BY locus_id, arrival) AS p FROM w)"""


@query(f"""
WITH {_MODEL},
r AS (SELECT l_orderkey AS arrival, (l_suppkey % 4)::int AS cand_idx, 100 + max(l_quantity::int) AS frag_len, 300 + 50 * (l_suppkey % 4) AS length, -sum(l_linenumber) / 10.0::double AS log_p FROM lineitem GROUP BY ALL),
w AS (SELECT arrival, cand_idx, exp(log_p) * exp(-power(frag_len - mean, 2) / (2 * sd * sd)) / (sd * sqrt(2 * pi())) / effective AS w FROM g, r JOIN effective USING (length))
SELECT arrival, cand_idx, round(w / sum(w) OVER (PARTITION BY arrival) + 1e-9::double, 6) AS p FROM w
""")
def q19_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the candidates of each order from read scores, fragment lengths and effective lengths."""
    cand = (F.col("l_suppkey") % 4).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("arrival"), cand.alias("cand_idx")).agg((F.lit(100) + F.max(F.col("l_quantity").cast("int"))).alias("frag_len"), (-F.sum("l_linenumber") / F.lit(10.0)).alias("log_p"))
    rows = rows.withColumn("length", (F.lit(300) + 50 * F.col("cand_idx")).cast("int"))
    model = _model(spark, sf_dir)
    found = likelihood.likelihoods(rows, lengths.effective_lengths(spark, 600, *model), *model)
    return likelihood.normalise(found, ["arrival"]).select("arrival", "cand_idx", F.round(F.col("p") + F.lit(1e-9), 6).alias("p"))


@query(f"""
WITH {_WEIGHTS}, r AS (SELECT locus_id, arrival, string_agg(cand_idx::varchar || ':' || cast(round(p * 100000)::bigint as varchar), ',' ORDER BY cand_idx) AS cells FROM p GROUP BY ALL)
SELECT locus_id, cells, count(*) AS n FROM r GROUP BY ALL
""")
def q20_collapse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c, p: F.concat(c.cast("string"), F.lit(":"), F.round(p * 100000).cast("long").cast("string"))
    found = likelihood.classes(_weights(spark, sf_dir), 12)
    shown = found.select("locus_id", F.array_join(F.zip_with("cands", "probs", cell), ",").alias("cells"), "n")
    return shown.groupBy("locus_id", "cells").agg(F.sum("n").alias("n"))


@query("""
WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT count(*)::double AS total FROM lineitem)
SELECT l_suppkey::varchar AS locus_id, 1.0::double AS confidence, round(n * 1e9 / (total * (100 + l_suppkey)), 4) AS fpkm, round(n::double, 4) AS expected_count FROM n, t
""")
def q21_fpkm_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    total = float(rows.count())
    per = rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).withColumn("locus_id", F.col("l_suppkey").cast("string"))
    grouped = per.select("locus_id", F.array(F.lit(0)).alias("cands"), F.array(F.lit(1.0)).alias("probs"), "n")
    survivors = per.select("locus_id", F.col("locus_id").alias("subgraph"), F.lit(0).alias("cand_idx"), (F.col("l_suppkey") + 100).cast("double").alias("effective"))
    found = sampler.confident(sampler.estimate(grouped, survivors, Options(), total), Options(), total)
    return found.select("locus_id", "confidence", F.round("mean_fpkm", 4).alias("fpkm"), F.round("expected_count", 4).alias("expected_count"))


@query("""
WITH RECURSIVE o AS (SELECT (l_suppkey % 40)::varchar AS locus_id, l_orderkey, bit_or(1 << (l_partkey % 12)::int) AS mask FROM lineitem GROUP BY ALL),
l AS (SELECT locus_id, list(DISTINCT mask) AS rows_left FROM o GROUP BY 1),
g AS (
  SELECT locus_id, -1 AS step, -1 AS cand_idx, rows_left FROM l
  UNION ALL
  SELECT locus_id, step + 1, best, list_filter(rows_left, lambda m: (m >> best) & 1 = 0)
  FROM (SELECT *, list_position(gains, list_max(gains)) - 1 AS best
    FROM (SELECT *, list_transform(range(12), lambda c: len(list_filter(rows_left, lambda m: (m >> c::int) & 1 = 1))) AS gains FROM g WHERE len(rows_left) > 0)))
SELECT locus_id, step::int AS step, cand_idx::int AS cand_idx FROM g WHERE step >= 0
""")
def q22_set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the greedy cover of each locus, in the order they were chosen."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).cast("string").alias("locus_id"), "l_orderkey").agg(F.sort_array(F.collect_set((F.col("l_partkey") % 12).cast("int"))).alias("cands"))
    return sampler.covers(rows, 12)


@query()
def q23_gibbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression of four candidates in each of 50 loci."""
    shares = _weights(spark, sf_dir)
    grouped = likelihood.classes(shares)
    survivors = shares.select("locus_id", F.col("locus_id").alias("subgraph"), "cand_idx").distinct().withColumn("effective", F.lit(500.0) + F.col("cand_idx") * 100)
    options = Options()
    total = float(table(spark, sf_dir, "orders").count())
    return sampler.confident(sampler.estimate(grouped, survivors, options, total), options, total)


@query("""
WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT *, unnest(range(2)) AS k FROM n)
SELECT 't' || l_suppkey::varchar AS name, 'chr' || (l_suppkey % 5)::varchar || chr(9) || 'helixloom' || chr(9) || 'exon' || chr(9) || (l_suppkey * 1000 + k * 300 + 1)::varchar || chr(9) || (l_suppkey * 1000 + k * 300 + 200)::varchar || chr(9) || '.' || chr(9) || '+' || chr(9) || '.' || chr(9)
  || 'gene_id "g' || l_suppkey::varchar || '"; transcript_id "t' || l_suppkey::varchar || '"; transcript_confidence "' || printf('%g', (l_suppkey % 8 + 1) / 8.0::double) || '"; FPKM "' || printf('%g', l_suppkey * l_suppkey * 234.5678901::double) || '"; FPKM_sd "'
  || CASE WHEN l_suppkey % 3 = 0 THEN 'nan' ELSE printf('%g', l_suppkey / 7000000.0::double) END || '"; expected_count "' || printf('%g', l_suppkey * 1000.0::double) || '";' AS line FROM x
""")
def q24_gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = F.col("l_suppkey")
    exon = lambda k: F.struct((supplier * 1000 + k * 300 + 1).alias("start"), (supplier * 1000 + k * 300 + 200).alias("end"))
    name = lambda p: F.concat(F.lit(p), supplier.cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().select(
        F.concat(F.lit("chr"), (supplier % 5).cast("string")).alias("ref"), F.lit("+").alias("strand"), name("g").alias("subgraph"), name("t").alias("name"), F.array(exon(0), exon(1)).alias("exons"),
        ((supplier % 8 + 1) / 8.0).alias("confidence"), (supplier * supplier * 234.5678901).alias("mean_fpkm"), F.when(supplier % 3 != 0, supplier / 7000000.0).alias("sd_fpkm"), (supplier * 1000.0).alias("expected_count"),
    )
    return sinks.gtf(rows).select("name", "line")


#: The defaults; the derived transcripts are shorter than those that the length model is trained on by default.
_WHOLE = Options(min_training_length=4 * synthetic.EXON)


@query()
def q26_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over fragments derived from the order lines; loci of two candidates are sampled."""
    lineitem = table(spark, sf_dir, "lineitem")
    found = assemble(synthetic.alignments(lineitem), *synthetic.splice_graphs(lineitem), _WHOLE).transcripts
    return found.select("ref", "strand", F.col("subgraph").alias("gene_id"), F.col("name").alias("transcript_id"), F.size("exons").alias("n_exons"), "length", "confidence", "mean_fpkm", "sd_fpkm", "expected_count")


@query("""
WITH f AS (SELECT l_suppkey, ((l_partkey * 37 + l_orderkey) % 650)::int AS t, 100 + l_quantity::int AS len FROM lineitem WHERE l_suppkey % 3 <> 0),
u AS (SELECT DISTINCT * FROM f), n AS (SELECT l_suppkey, count(*) AS n, bool_or(t < 200) AND bool_or(t + len > 600) AS ends FROM u GROUP BY 1)
SELECT 'g' || l_suppkey::varchar AS gene_id, 4 AS n_exons, 800 AS length, 1.0::double AS confidence, round(n::double, 4) AS expected_count FROM n WHERE n >= 12 AND ends
""")
def q27_assembly_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-path loci of a run over all lines without pre-mRNA, so with one candidate: every distinct fragment counts."""
    lineitem = table(spark, sf_dir, "lineitem")
    graph_table, segments, path_rows = synthetic.splice_graphs(lineitem)
    single = _single(path_rows, segments)
    done = assemble(synthetic.alignments(lineitem), graph_table, segments, path_rows, replace(_WHOLE, pre_mrna=False))
    found = done.transcripts.join(single, "subgraph", "left_semi")
    return found.select(F.col("subgraph").alias("gene_id"), F.size("exons").alias("n_exons"), "length", "confidence", F.round("expected_count", 4).alias("expected_count"))


@query("""
WITH f AS (SELECT l_suppkey, ((l_partkey * 37 + l_orderkey) % 650)::int AS t, 100 + l_quantity::int AS len FROM lineitem WHERE l_suppkey % 3 <> 0),
u AS (SELECT DISTINCT * FROM f), n AS (SELECT l_suppkey, count(*) AS n, bool_or(t < 200) AND bool_or(t + len > 600) AS ends FROM u GROUP BY 1)
SELECT CASE WHEN NOT ends THEN 3 WHEN n < 590.5 THEN 7 ELSE 0 END AS return_code, count(*) AS n FROM n GROUP BY 1
""")
def q25_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the single-path loci of a run ended, when a transcript needs more than 590 expected fragments."""
    lineitem = table(spark, sf_dir, "lineitem")
    graph_table, segments, path_rows = synthetic.splice_graphs(lineitem)
    done = assemble(synthetic.alignments(lineitem), graph_table, segments, path_rows, replace(_WHOLE, pre_mrna=False, count_threshold=590.5))
    return sinks.status_counts(done.status.join(_single(path_rows, segments).withColumnRenamed("subgraph", "locus_id"), "locus_id", "left_semi"))


@query("""
WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1),
g AS (SELECT 'g' || l_suppkey::varchar AS id, 'chr' || (l_suppkey % 5)::varchar AS ref, ((l_suppkey // 5) * 1000 + 1)::int AS l, ((l_suppkey // 5) * 1000 + CASE WHEN l_suppkey % 3 = 0 THEN 1400 ELSE 900 END)::int AS r, n,
  CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 1 END AS paths FROM s),
o AS (SELECT *, CASE WHEN l <= max(r) OVER (PARTITION BY ref ORDER BY l, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM g),
i AS (SELECT *, sum(opens) OVER (PARTITION BY ref ORDER BY l, id ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT min(id) AS locus_id, ref, min(l) AS "left", max(r) AS "right", sum(n)::bigint AS read_count, count(*) = 1 AND max(paths) = 1 AS single_path, count(*) AS n_graphs, (sum(paths) + count(*))::bigint AS n_candidates, count(*) AS n_pre_mrna,
  sum(r - l + 1)::bigint AS pre_mrna_length FROM i GROUP BY ref, island
""")
def q28_loci_with_pre_mrna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping graphs merged to loci, and their candidates with a pre-mRNA for each graph."""
    lineitem = table(spark, sf_dir, "lineitem")
    key = F.substring("graph_id", 2, 20).cast("long")
    start = (F.floor(key / 5) * 1000).cast("int")
    made, segments, path_rows = synthetic.splice_graphs(lineitem)
    bounds = made.select("graph_id", F.concat(F.lit("chr"), (key % 5).cast("string")).alias("ref"), "strand", (start + 1).alias("left"), (start + F.when(key % 3 == 0, 1400).otherwise(900)).cast("int").alias("right"), "read_count")
    segments = segments.select("graph_id", "idx", (start + 100 * F.col("idx") + 1).cast("int").alias("start"), (start + 100 * F.col("idx") + 50).cast("int").alias("end"), "zero_frac")
    kept = graphs.kept_segments(segments)
    edges = graphs.junctions(path_rows, kept)
    bounds = graphs.widened(bounds, kept)
    loci = graphs.loci(bounds, graphs.single_path(edges))
    found = paths.named(paths.candidates(bounds, kept, edges), loci)
    per = found.groupBy("locus_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("is_pre_mrna").alias("n_pre_mrna"), F.sum(F.when(F.col("is_pre_mrna"), F.col("length"))).alias("pre_mrna_length"))
    return loci.join(per, "locus_id").select("locus_id", "ref", "left", "right", "read_count", "single_path", F.size("members").cast("long").alias("n_graphs"), "n_candidates", "n_pre_mrna", "pre_mrna_length")


@query("""
WITH u AS (SELECT DISTINCT l_suppkey, ((l_partkey * 37 + l_orderkey) % 650)::int AS t, 100 + l_quantity::int AS len FROM lineitem WHERE l_suppkey % 3 <> 0),
m AS (SELECT median(len) AS mean FROM u)
SELECT len AS length, count(*) AS n, (SELECT mean FROM m) AS mean, (SELECT round(1.4826::double * median(abs(len - mean)), 6) FROM u, m) AS sd FROM u GROUP BY len
""")
def q29_length_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragment lengths over long transcripts of single-path loci, and the model they give."""
    lineitem = table(spark, sf_dir, "lineitem")
    graph_table, segments, path_rows = synthetic.splice_graphs(lineitem)
    done = assemble(synthetic.alignments(lineitem), graph_table, segments, path_rows, _WHOLE)
    mean, sd = done.model
    return done.lengths.select("length", "n", F.lit(mean).alias("mean"), F.round(F.lit(sd), 6).alias("sd"))


@query("""
WITH r AS (SELECT DISTINCT (l_suppkey % 50 * 20)::int AS s1, (l_linenumber % 3)::int AS shape, (5 + l_partkey % 20)::int AS a, (l_quantity::int % 3 * 70)::int AS gap FROM lineitem),
x AS (SELECT k::int AS k, 100 * k + 1 AS es, 100 * k + 60 AS ee FROM range(12) t(k)),
d AS (SELECT *, s1 + gap AS s2, CASE shape WHEN 0 THEN 2 * a ELSE 2 * a - 1 END AS reach FROM r),
e AS (SELECT *, CASE shape WHEN 0 THEN 2 * a WHEN 1 THEN 2 * a - 1 ELSE 2 * a + 2 END AS span FROM d)
SELECT s1, shape, a, gap, p.k AS first_exon, q.k AS last_exon, (60 * (q.k - p.k) + (s2 + span - q.es) - (s1 + 1 - p.es) + 1)::int AS frag_len,
  (60 * q.k + s2 + span - q.es + 1)::int AS forward_end, (720 - (60 * p.k + s1 + 1 - p.es + 1) + 1)::int AS reverse_end
FROM e JOIN x p ON s1 + 1 BETWEEN p.es AND p.ee JOIN x q ON s2 + 1 BETWEEN q.es AND q.ee
WHERE s1 + span <= p.ee AND s2 + span <= q.ee AND (shape <> 2 OR (s1 + a + 3 <= p.ee AND s2 + a + 3 <= q.ee)) AND (shape <> 1 OR (s1 + a <= p.ee AND s2 + a <= q.ee))
""")
def q30_fragment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both mates of a fragment with an insertion or a deletion on an exon chain: exons, length, and the 3' place on either strand."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_suppkey") % 50 * 20).cast("int").alias("s1"), (c("l_linenumber") % 3).cast("int").alias("shape"), (c("l_partkey") % 20 + 5).cast("int").alias("a"), (c("l_quantity").cast("int") % 3 * 70).cast("int").alias("gap")).distinct()
    half = _op("M", c("a"))
    shape = F.when(c("shape") == 0, F.array(_op("M", 2 * c("a")))).when(c("shape") == 1, F.array(half, _op("I", 3), half)).otherwise(F.array(half, _op("D", 2), half))
    exons = F.array(*[F.struct(F.lit(100 * k + 1).alias("start"), F.lit(100 * k + 60).alias("end")) for k in range(12)])
    s2 = (c("s1") + c("gap")).cast("int")
    found = matching.fitted(rows, c("s1"), shape, s2, shape, exons, {"m": F.lit("+"), "w": F.lit("-")})
    return found.select("s1", "shape", "a", "gap", "m.first_exon", "m.last_exon", "m.frag_len", c("m.three_prime").alias("forward_end"), c("w.three_prime").alias("reverse_end"))


def _kept_text(lines: DataFrame, name: str) -> str:
    """Where the lines (a column value) are written as a text file that readers can be tried on."""
    path = f"{shared_dir(lines.sparkSession)}/helixloom/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


@query("""
SELECT l_orderkey::varchar || '.' || l_linenumber::varchar AS name, 'chr' || (l_suppkey % 5)::varchar AS ref, l_partkey::int - 1 AS pos, 'chr' || (l_suppkey % 5)::varchar AS mate_ref, (l_partkey + 100)::int - 1 AS mate_pos, l_quantity::int AS insert_size,
  l_linenumber::varchar || 'M2I5M' AS cigar, l_linenumber % 2 = 0 AS is_rev, l_linenumber % 2 = 1 AS is_first, (l_partkey % 3)::int AS nh, l_linenumber::varchar || 'A4' AS md, count(*) AS n
FROM lineitem GROUP BY ALL
""")
def q31_sam_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines written as SAM text and read back."""
    c, text = F.col, lambda x: x.cast("string")
    line = F.concat_ws(
        "\t", F.concat_ws(".", text(c("l_orderkey")), text(c("l_linenumber"))), text(F.lit(3) + F.when(c("l_linenumber") % 2 == 0, 16 + 128).otherwise(64)), F.concat(F.lit("chr"), text(c("l_suppkey") % 5)), text(c("l_partkey")), F.lit("50"),
        F.concat(text(c("l_linenumber")), F.lit("M2I5M")), F.lit("="), text(c("l_partkey") + 100), text(c("l_quantity").cast("int")), F.lit("*"), F.lit("IIII"), F.concat(F.lit("MD:Z:"), text(c("l_linenumber")), F.lit("A4")), F.concat(F.lit("NH:i:"), text(c("l_partkey") % 3)),
    )
    rows = table(spark, sf_dir, "lineitem").select(line.alias("value"))
    found = alignments.read_sam(spark, _kept_text(rows.unionByName(rows.limit(1).select(F.lit("@HD\tVN:1.0").alias("value"))), "sam"))
    shape = F.array_join(F.transform("cigar", lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return found.groupBy("name", "ref", "pos", "mate_ref", "mate_pos", "insert_size", shape.alias("cigar"), "is_rev", "is_first", "nh", "md").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'g' || l_suppkey::varchar AS graph_id, 'chr' || (l_suppkey % 5)::varchar AS ref, '+' AS strand, (l_suppkey * 10000 + 1)::int AS "left", (l_suppkey * 10000 + 1400)::int AS "right", n AS read_count, 4::bigint AS n_segments, (4 * l_suppkey * 10000 + 2404)::bigint AS starts,
  CASE WHEN l_suppkey % 3 = 0 THEN 15 ELSE 10 END::bigint AS n_paths FROM s
""")
def q32_instance_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splice graphs of the suppliers written as instance text and read back."""
    lineitem = table(spark, sf_dir, "lineitem")
    g, s, p = instances.read_instances(spark, _kept_text(instances.to_text(*synthetic.splice_graphs(lineitem)), "instances"))
    per = s.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("start").alias("starts"))
    return g.join(per, "graph_id").join(p.groupBy("graph_id").agg(F.sum("n").alias("n_paths")), "graph_id").select("graph_id", "ref", "strand", "left", "right", "read_count", "n_segments", "starts", "n_paths")


@query("""
WITH h AS (SELECT l_quantity::int AS length, count(*)::double / sum(count(*)) OVER () AS p FROM lineitem WHERE l_quantity < 45 GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(coalesce(p, 0), 8) AS p FROM lineitem LEFT JOIN h ON length = l_quantity::int
""")
def q33_length_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of quantities written as a file of length probabilities, read back and looked up."""
    lineitem = table(spark, sf_dir, "lineitem").withColumn("frag_len", F.col("l_quantity").cast("int"))
    counts = lengths.histogram(lineitem.filter("l_quantity < 45"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    given = read_lengths(spark, _kept_text(counts.select(F.concat_ws(" ", F.col("length").cast("string"), (F.col("n") / F.lit(float(total))).cast("string")).alias("value")), "lengths"))
    return lengths.empirical(lineitem.select("l_orderkey", "l_linenumber", "frag_len"), given).select("l_orderkey", "l_linenumber", F.round("p", 8).alias("p"))


_EVIDENCE = """
e AS (SELECT l_suppkey, count(*) FILTER (WHERE l_quantity = 50) AS n0, count(*) FILTER (WHERE l_quantity = 1 AND l_linenumber = 7) AS n1, count(*) FILTER (WHERE l_quantity = 49) AS m FROM lineitem GROUP BY 1)"""


@query(f"""
WITH {_EVIDENCE}, x AS (SELECT *, unnest(range(2)) AS c FROM e WHERE n0 + n1 + m > 0)
SELECT l_suppkey::varchar AS locus_id, c::int AS cand_idx, round(CASE WHEN n0 > 0 AND n1 > 0 THEN 1 WHEN n0 + n1 = 0 THEN 2 / 3.0::double WHEN (c = 0) = (n0 > 0) THEN 1 ELSE 1 / (n0 + n1 + 2)::double END, 6) AS confidence,
  CASE WHEN m > 0 THEN NULL WHEN n0 > 0 AND n1 > 0 THEN round((CASE c WHEN 0 THEN n0 ELSE n1 END + 1) / (n0 + n1 + 2)::double, 6) WHEN (c = 0) = (n0 > 0) THEN round(1 - 1 / power(n0 + n1 + 2, 2), 6) ELSE round(1 / (n0 + n1 + 2)::double, 6) END AS mean_share FROM x
""")
def q34_gibbs_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates with fragments of their own (n0, n1) and m that fit both alike: sampled confidence and mean share, put to their exact values where they are within four standard errors.

    With a cover of one candidate out of two, the other is in the simplex with probability 1 / (n + 2). Errors are those of a
    quarter as many independent samples; means while included are exact where no fragment is shared.
    """
    n0, n1, n = F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1")
    per = _evidence(spark, sf_dir).filter("n0 + n1 + m > 0")
    grouped, survivors = _two_candidates(per)
    found = sampler.estimate(grouped, survivors, Options(), 1e6).join(per, "locus_id")
    first = F.col("cand_idx") == 0
    own = first == (n0 > 0)
    exact = F.when((n0 > 0) & (n1 > 0), 1.0).when(n == 0, 2 / 3).when(own, 1.0).otherwise(1 / (n + 2))
    sampled = F.col("occurrences") / F.col("n_iter")
    independent = F.col("n_iter") / 4
    share = F.col("mean_fpkm") * F.col("effective") * F.lit(1e6) / (n * F.lit(1e9))
    mine = F.when(first, n0).otherwise(n1)
    mean = F.when((n0 > 0) & (n1 > 0), (mine + 1) / (n + 2)).when(own, 1 - 1 / F.pow(n + 2, F.lit(2))).otherwise(1 / (n + 2))
    error = F.sqrt((n + 1) / (F.pow(n + 2, F.lit(2)) * (n + 3)) / (independent * F.least(exact, 1 / (n + 2)))) + 1e-9
    snap = lambda value, to, within: F.when(F.abs(value - to) <= 4 * within, to).otherwise(value)
    return found.select("locus_id", "cand_idx", F.round(snap(sampled, exact, F.sqrt(exact * (1 - exact) / independent)), 6).alias("confidence"), F.when(F.col("m") == 0, F.round(snap(share, mean, error), 6)).alias("mean_share"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus_id, n0, n1 and m: fragments of the first and second of two candidates, and of both."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("locus_id")).agg(F.count_if(q == 50).alias("n0"), F.count_if((q == 1) & (F.col("l_linenumber") == 7)).alias("n1"), F.count_if(q == 49).alias("m"))


def _two_candidates(per: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes and survivors of two candidates with this evidence."""
    one = lambda cands, probs, n: F.struct(F.array(*map(F.lit, cands)).alias("cands"), F.array(*map(F.lit, probs)).alias("probs"), F.col(n).alias("n"))
    grouped = per.select("locus_id", F.explode(F.array(one([0], [1.0], "n0"), one([1], [1.0], "n1"), one([0, 1], [0.5, 0.5], "m"))).alias("c")).select("locus_id", "c.*").filter("n > 0")
    return grouped, per.select("locus_id", F.col("locus_id").alias("subgraph"), F.explode(F.array(F.lit(0), F.lit(1))).alias("cand_idx"), F.lit(500.0).alias("effective"))


@query("""
WITH p AS (SELECT event_id, 'c' || (user_id % 3)::varchar AS ref, (event_id // 20)::int AS pos1, (user_id % 4 * 30)::int AS gap, (1 + event_id % 3)::int AS nh FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY ref, pos1, gap ORDER BY nh <> 1, event_id) AS k FROM p)
SELECT ref, pos1, (pos1 + gap)::int AS pos2, event_id::varchar AS name, nh, true AS in_order FROM r WHERE k = 1
""")
def q35_stream_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as read pairs, streamed file by file: duplicates collapse and are released in the order of position."""
    c, at = F.col, F.floor(F.col("event_id") / 20).cast("int")
    gap = (c("user_id") % 4 * 30).cast("int")
    ref = F.concat(F.lit("c"), (c("user_id") % 3).cast("string"))
    mates = table(spark, sf_dir, "events").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        c("event_id").cast("string").alias("name"), ref.alias("ref"), (at + c("k") * gap).cast("int").alias("pos"), ref.alias("mate_ref"), (at + (1 - c("k")) * gap).cast("int").alias("mate_pos"), ((gap + 10) * (1 - 2 * c("k"))).cast("int").alias("insert_size"),
        F.array(_op("M", 10)).alias("cigar"), F.lit("I" * 10).alias("qual"), *[F.lit(x).alias(n) for n, x in (("is_paired", True), ("is_qcfail", False), ("is_mapped", True), ("is_primary", True), ("mate_mapped", True))],
        (c("k") == 1).alias("is_rev"), (c("k") == 0).alias("mate_rev"), (c("k") == 0).alias("is_first"), (1 + c("event_id") % 3).cast("int").alias("nh"), F.lit(None).cast("int").alias("hi"), F.lit("10").alias("md"), (2 * c("event_id") + c("k")).alias("arrival"),
    )
    longest = (mates.agg(F.max("pos")).first()[0] or 0) + 1
    path = f"{shared_dir(spark)}/helixloom/stream-{uuid.uuid4().hex}"
    unplaced = mates.limit(1).withColumns({"ref": F.lit(None).cast("string"), "pos": F.lit(-1), "is_mapped": F.lit(False)})
    for part in [*[mates.filter(c("ref") == f"c{k}") for k in range(3)], unplaced]:
        part.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(mates.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    found = duplicates.collapse_stream(stream, [(f"c{k}", longest) for k in range(3)], delay=longest)
    written_out = duplicates.write_sorted(found, f"{path}/out", f"{path}/checkpoint")
    written_out.awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    ends = rows.groupBy("ref", "bin", "batch").agg(F.min("pos1").alias("first"), F.max("pos1").alias("last"))
    follows = ends.withColumn("in_order", F.coalesce(c("first") >= F.max("last").over(Window.partitionBy("ref", "bin").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    return rows.join(F.broadcast(follows.select("ref", "bin", "batch", "in_order")), ["ref", "bin", "batch"]).select("ref", "pos1", c("b.pos").alias("pos2"), "name", c("b.nh").alias("nh"), "in_order")


@query("""
SELECT l_orderkey::varchar || '.' || l_linenumber::varchar AS name, 'chr1' AS ref, (l_partkey * 50)::int AS pos, (l_partkey * 50 + 30)::int AS mate_pos, l_quantity::int AS insert_size, (10 + l_linenumber)::varchar || 'M' AS cigar,
  l_linenumber % 2 = 0 AS is_rev, l_linenumber % 2 = 1 AS is_first, (1 + l_partkey % 3)::int AS nh, (l_linenumber % 4 = 0) AS no_hi, (10 + l_linenumber)::varchar AS md, count(*) AS n
FROM lineitem WHERE l_suppkey % 5 = 1 AND l_partkey * 50 >= 1000 AND l_partkey * 50 < 9000 GROUP BY ALL
""")
def q36_bam_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines written as sorted BAM files with an index, and a region read back through it."""
    c, lineitem = F.col, table(spark, sf_dir, "lineitem")
    ref, size = F.concat(F.lit("chr"), (c("l_suppkey") % 5).cast("string")), (c("l_linenumber") + 10).cast("int")
    pos = (c("l_partkey") * 50).cast("int")
    records = lineitem.select(
        F.concat_ws(".", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("name"), ref.alias("ref"), pos.alias("pos"), ref.alias("mate_ref"), (pos + 30).alias("mate_pos"), c("l_quantity").cast("int").alias("insert_size"),
        F.array(_op("M", size)).alias("cigar"), F.repeat(F.lit("I"), size).alias("qual"), *[F.lit(x).alias(n) for n, x in (("is_paired", True), ("is_qcfail", False), ("is_mapped", True), ("is_primary", True), ("mate_mapped", True))],
        (c("l_linenumber") % 2 == 0).alias("is_rev"), (c("l_linenumber") % 2 == 1).alias("mate_rev"), (c("l_linenumber") % 2 == 1).alias("is_first"), (1 + c("l_partkey") % 3).cast("int").alias("nh"), F.when(c("l_linenumber") % 4 != 0, c("l_linenumber").cast("int")).alias("hi"), size.cast("string").alias("md"),
        F.monotonically_increasing_id().alias("arrival"),
    )
    longest = int(records.agg(F.max("pos")).first()[0] or 0) + 100
    path = f"{shared_dir(spark)}/helixloom/bam-{uuid.uuid4().hex}"
    bam.write(records, path, [(f"chr{k}", longest) for k in range(5)])
    bam.index(spark, path)
    found = spark.read.format("bam").load(path).filter("ref = 'chr1' AND pos >= 1000 AND pos < 9000")
    shown = found.select("name", "ref", "pos", "mate_pos", "insert_size", F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), x["op"])), "").alias("cigar"), "is_rev", "is_first", "nh", c("hi").isNull().alias("no_hi"), "md")
    return shown.groupBy(shown.columns).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH f AS (SELECT DISTINCT l_suppkey, ((l_partkey * 37 + l_orderkey) % 650)::int AS t, 100 + l_quantity::int AS len FROM lineitem WHERE l_suppkey % 3 <> 0),
h AS (SELECT 100 + l_quantity::int AS len, count(*)::double / sum(count(*)) OVER () AS p FROM lineitem WHERE l_quantity < 45 AND l_quantity % 7 <> 0 GROUP BY 1),
e AS (SELECT sum(p * (800 - len + 1)) AS effective FROM h),
n AS (SELECT l_suppkey, count(p) AS n, bool_or(t < 200) AND bool_or(t + len > 600) AS ends FROM f LEFT JOIN h USING (len) GROUP BY 1)
SELECT 'g' || l_suppkey::varchar AS gene_id, 1.0::double AS confidence, round(n::double, 4) AS expected_count, round(effective, 6) AS effective FROM n, e WHERE n >= 12 AND ends
""")
def q37_empirical_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-path loci of a run under a file of length probabilities: fragments of other lengths don't count."""
    lineitem = table(spark, sf_dir, "lineitem")
    length = (F.col("l_quantity").cast("int") + 100).alias("frag_len")
    counts = lengths.histogram(lineitem.filter("l_quantity < 45 AND l_quantity % 7 != 0").select(length))
    total = counts.agg(F.sum("n")).first()[0] or 1
    given = read_lengths(spark, _kept_text(counts.select(F.concat_ws(" ", F.col("length").cast("string"), (F.col("n") / F.lit(float(total))).cast("string")).alias("value")), "lengths"))
    graph_table, segments, path_rows = synthetic.splice_graphs(lineitem)
    done = assemble(synthetic.alignments(lineitem), graph_table, segments, path_rows, replace(_WHOLE, pre_mrna=False), lengths.Empirical(given))
    found = done.transcripts.join(_single(path_rows, segments), "subgraph", "left_semi")
    return found.select(F.col("subgraph").alias("gene_id"), "confidence", F.round("expected_count", 4).alias("expected_count"), F.round("effective", 6).alias("effective"))


@query("""
WITH r AS (SELECT DISTINCT l_suppkey AS s, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, ((l_partkey * 37 + l_orderkey) % 650)::int AS t, 100 + l_quantity::int AS len FROM lineitem),
u AS (SELECT DISTINCT s, t, len FROM r),
n AS (SELECT s, count(*) FILTER (WHERE t % 5 <> 0 AND t % 7 <> 0) AS n, bool_or(t < 200) FILTER (WHERE t % 5 <> 0 AND t % 7 <> 0) AND bool_or(t + len > 600) FILTER (WHERE t % 5 <> 0 AND t % 7 <> 0) AS ends FROM u WHERE s % 3 <> 0 AND s % 10 <> 1 GROUP BY s),
c AS (SELECT CASE WHEN s % 10 = 2 THEN 'no fragment' WHEN NOT ends THEN 'code 3' WHEN s % 10 = 9 THEN 'code 4' WHEN n < 12 THEN 'code 7' ELSE 'code 0' END AS what FROM n)
SELECT what, count(*) AS n FROM c GROUP BY what
UNION ALL SELECT 'mapped', 2 * count(*) FROM r UNION ALL SELECT 'unique pairs', count(*) FROM u WHERE t % 7 <> 0
UNION ALL SELECT 'no strand', count(DISTINCT s) FROM r WHERE s % 10 = 1 UNION ALL SELECT 'no MD', 2 * count(*) FROM r WHERE s % 10 = 9
""")
def q38_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose reads hit several places, whose graphs have no strand or lie where no fragment is, and whose records lack what they need: what is counted, and how single-path loci end."""
    lineitem, c = table(spark, sf_dir, "lineitem"), F.col
    graph_table, segments, path_rows = synthetic.splice_graphs(lineitem)
    supplier = F.regexp_extract("graph_id", "g(.*)", 1).cast("long")
    graph_table = graph_table.withColumn("strand", F.when(supplier % 10 == 1, ".").otherwise(c("strand"))).withColumn("ref", F.when(supplier % 10 == 2, "elsewhere").otherwise(c("ref")))
    per = lineitem.select(F.lit(1).alias("one"), "*")
    records = synthetic.alignments(per)
    # The place of a fragment in its transcript follows from where its first mate begins.
    first = F.least("pos", "mate_pos")
    place = first % synthetic.LOCUS
    t = F.floor(place / 400) * synthetic.EXON + place % 400
    several = F.when(c("is_first"), t % 5 == 0).otherwise(t % 7 == 0)
    records = records.withColumn("nh", F.when(several, 2).otherwise(1)).withColumn("md", F.when(F.floor(first / synthetic.LOCUS) % 10 == 9, None).otherwise(c("md")))
    done = assemble(records, graph_table, segments, path_rows, replace(_WHOLE, pre_mrna=False, frag_mean=125.0, frag_sd=20.0))
    single = done.status.join(_single(path_rows, segments).withColumnRenamed("subgraph", "locus_id"), "locus_id", "left_semi")
    what = F.when(c("return_code").isNull(), "no fragment").otherwise(F.concat(F.lit("code "), c("return_code").cast("string")))
    counts = [("mapped", done.counts[0]), ("unique pairs", done.counts[1]), *((k, n) for k, n in done.left_out.items() if n)]
    return single.groupBy(what.alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(spark.createDataFrame(counts, "what string, n long"))


@query("""
WITH g AS (SELECT DISTINCT l_suppkey AS s FROM lineitem),
n AS (SELECT s, s % 4 AS kind, CASE s % 4 WHEN 2 THEN 5 WHEN 3 THEN 3 ELSE 1 END AS segs FROM g),
c AS (
  SELECT s, 'g' || s::varchar || '_seq' || k::varchar AS name, 1 AS n_exons, 50 AS length FROM n, range(5) t(k) WHERE kind IN (0, 1) AND k = 0 OR kind = 2 AND k < 2
  UNION ALL SELECT s, 'g' || s::varchar || '_seq' || k::varchar, 3 - k, 50 * (3 - k) FROM n, range(2) t(k) WHERE kind = 3
  UNION ALL SELECT s, 'g' || s::varchar || '_pre', 1, CASE kind WHEN 1 THEN 60 ELSE 100 * segs - 50 END FROM n WHERE kind <> 0)
SELECT 'g' || s::varchar AS locus_id, name, (row_number() OVER (PARTITION BY s ORDER BY name LIKE '%pre', name) - 1)::int AS cand_idx, n_exons::int AS n_exons, length::int AS length FROM c
""")
def q39_candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of one segment, of segments without edges beyond the limit, and of two paths: which candidates there are and what they are called."""
    c = F.col
    per = table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().withColumn("kind", c("l_suppkey") % 4).withColumn("graph_id", F.concat(F.lit("g"), c("l_suppkey").cast("string")))
    base = c("l_suppkey") * 1000
    n = F.when(c("kind") == 2, 5).when(c("kind") == 3, 3).otherwise(1)
    right = base + F.when(c("kind") == 0, 50).when(c("kind") == 1, 60).otherwise(100 * n - 50)
    graph_table = per.select("graph_id", F.lit("chr1").alias("ref"), F.lit("+").alias("strand"), (base + 1).cast("int").alias("left"), right.cast("int").alias("right"), F.lit(1).cast("long").alias("read_count"))
    segments = per.withColumn("idx", F.explode(F.sequence(F.lit(0), n - 1))).select("graph_id", "idx", (base + 100 * c("idx") + 1).cast("int").alias("start"), (base + 100 * c("idx") + 50).cast("int").alias("end"), F.lit(0.0).alias("zero_frac"))
    rows = per.filter("kind = 3").select("graph_id", F.explode(F.array(F.struct(F.lit(0).alias("row"), F.array(*map(F.lit, [1, 1, 1])).alias("flags"), F.lit(9).cast("long").alias("n")), F.struct(F.lit(1).alias("row"), F.array(*map(F.lit, [1, 0, 1])).alias("flags"), F.lit(4).cast("long").alias("n")))).alias("r")).select("graph_id", "r.*")
    edges = graphs.junctions(rows, graphs.kept_segments(segments))
    bounds = graphs.widened(graph_table, segments)
    loci = graphs.loci(bounds, graphs.single_path(edges), collapse=False)
    found = paths.named(paths.candidates(bounds, segments, edges, 3), loci)
    return found.select("locus_id", "name", "cand_idx", F.size("exons").alias("n_exons"), "length")


@query(f"""
WITH {_EVIDENCE}, x AS (SELECT *, unnest(range(2)) AS c FROM e WHERE n0 + n1 + m > 0)
SELECT l_suppkey::varchar AS locus_id, c::int AS cand_idx, round(CASE WHEN n0 > 0 AND n1 > 0 THEN 1 WHEN n0 + n1 = 0 THEN 0.75 WHEN (c = 0) = (n0 > 0) THEN 1 ELSE 2 / (n0 + n1 + 3)::double END, 6) AS confidence FROM x
""")
def q40_beta_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As q34, with a uniform prior of the share of candidates that are expressed: another candidate is there with probability 2 / (n + 3)."""
    n0, n1, n = F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1")
    per = _evidence(spark, sf_dir).filter("n0 + n1 + m > 0")
    found = sampler.estimate(*_two_candidates(per), Options(inclusion_prior=(1.0, 1.0), start="cover"), 1e6).join(per, "locus_id")
    exact = F.when((n0 > 0) & (n1 > 0), 1.0).when(n == 0, 0.75).when((F.col("cand_idx") == 0) == (n0 > 0), 1.0).otherwise(2 / (n + 3))
    sampled = F.col("occurrences") / F.col("n_iter")
    within = F.abs(sampled - exact) <= 4 * F.sqrt(exact * (1 - exact) / (F.col("n_iter") / 4))
    return found.select("locus_id", "cand_idx", F.round(F.when(within, exact).otherwise(sampled), 6).alias("confidence"))


@query(f"""
WITH {_EVIDENCE}, x AS (SELECT *, unnest(range(2)) AS c FROM e WHERE n0 + n1 > 0)
SELECT l_suppkey::varchar AS locus_id, c::int AS cand_idx, CASE WHEN n0 > 0 AND n1 > 0 OR (c = 0) = (n0 > 0) THEN 1 ELSE 0 END AS kept,
  CASE WHEN n0 > 0 AND n1 > 0 THEN round((CASE c WHEN 0 THEN n0 ELSE n1 END + 1) / (n0 + n1 + 2)::double, 6) WHEN (c = 0) = (n0 > 0) THEN 1 END AS mean_share,
  CASE WHEN n0 > 0 AND n1 > 0 THEN round(sqrt((n0 + 1) * (n1 + 1) / (power(n0 + n1 + 2, 2) * (n0 + n1 + 3))), 6) WHEN (c = 0) = (n0 > 0) THEN 0 END AS sd_share FROM x
""")
def q41_fixed_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression sampled again with the most frequent set of candidates: a Beta mean and deviation where both are in it."""
    n0, n1, n = F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1")
    per = _evidence(spark, sf_dir).filter("n0 + n1 > 0")
    found = sampler.estimate(*_two_candidates(per), Options(fixed_support=True), 1e6).join(per, "locus_id")
    both, mine = (n0 > 0) & (n1 > 0), F.when(F.col("cand_idx") == 0, n0).otherwise(n1)
    to_share = F.col("effective") * F.lit(1e6) / ((n + F.col("m")) * F.lit(1e9))
    sd = F.when(both, F.sqrt((n0 + 1) * (n1 + 1) / (F.pow(n + 2, F.lit(2)) * (n + 3)))).otherwise(0.0)
    mean = F.when(both, (mine + 1) / (n + 2)).otherwise(1.0)
    snap = lambda value, to, within: F.round(F.when(F.abs(value - to) <= within, to).otherwise(value), 6)
    draws = F.col("n_iter") / 4
    return found.select("locus_id", "cand_idx", (F.col("occurrences") == F.col("n_iter")).cast("int").alias("kept"), snap(F.col("mean_fpkm") * to_share, mean, 4 * sd / F.sqrt(draws) + 1e-9).alias("mean_share"), snap(F.col("sd_fpkm") * to_share, sd, 4 * sd / F.sqrt(draws) + 1e-9).alias("sd_share"))


@query("""
WITH v AS (SELECT l_suppkey, l_suppkey % 5 AS ref, sum(l_quantity)::double AS v FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round(v / (100 + l_suppkey) / sum(v / (100 + l_suppkey)) OVER (PARTITION BY ref), 9) AS share FROM v
""")
def q42_expression_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the suppliers of a reference in what is expressed, relative to their lengths."""
    values = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_suppkey") % 5).alias("ref")).agg(F.sum("l_quantity").cast("double").alias("v"))
    return lengths.normalise_expression(values.withColumn("length", F.lit(100) + F.col("l_suppkey")), "v", "length", ["ref"]).select("l_suppkey", F.round("share", 9).alias("share"))


@query(f"""
WITH m AS (SELECT count(*) AS mapped FROM ({_RECORDS})), u AS (SELECT count(*) AS pairs FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE 1 + l_partkey % 3 = 1))
SELECT mapped, pairs, round(CASE WHEN mapped = 0 THEN 0 ELSE 5000000 * (2 * pairs / mapped::double) END, 4) AS relative FROM m, u
""")
def q43_library_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What expression is relative to when the number of sequenced pairs is given: its part that is left as unique pairs."""
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct((1 + F.col("l_partkey") % 3).alias("nh")).alias("b")).dropDuplicates(["l_orderkey", "b"])
    found = dedup.library_counts(_records(spark, sf_dir), pairs, Options(library_size=5_000_000))
    return spark.createDataFrame([found], "mapped long, pairs long, relative double").select("mapped", "pairs", F.round("relative", 4).alias("relative"))
