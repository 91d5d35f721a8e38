"""Splice graphs from instance text: graphs, segments and path rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _section(body: Column, start: str, stop: str) -> Column:
    """Lines between the line that begins with ``start`` and the one that begins with ``stop``."""
    text = F.regexp_extract(body, rf"(?ms)^{start}[ \t]+[^\n]*\n(.*?)^{stop}[ \t]", 1)
    return F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)


def from_text(bodies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, segments, path_rows) of rows ``value`` that each hold one instance without its first word.

    Reference names may hold any character but white space.
    """
    parsed = bodies.filter(F.trim("value") != "").select(
        F.regexp_extract("value", r"^\s*(\S+)", 1).alias("graph_id"),
        F.regexp_extract("value", r"(?m)^Boundary[ \t]+(\S+)[ \t]+(\d+)[ \t]+(\d+)[ \t]+([+.-])", 1).alias("ref"),
        F.regexp_extract("value", r"(?m)^Boundary[ \t]+(\S+)[ \t]+(\d+)[ \t]+(\d+)[ \t]+([+.-])", 4).alias("strand"),
        F.regexp_extract("value", r"(?m)^Boundary[ \t]+(\S+)[ \t]+(\d+)[ \t]+(\d+)[ \t]+([+.-])", 2).try_cast("int").alias("left"),
        F.regexp_extract("value", r"(?m)^Boundary[ \t]+(\S+)[ \t]+(\d+)[ \t]+(\d+)[ \t]+([+.-])", 3).try_cast("int").alias("right"),
        F.regexp_extract("value", r"(?m)^Reads[ \t]+(\d+)", 1).try_cast("long").alias("read_count"),
        _section(F.col("value"), "Segs", "Refs").alias("segs"),
        _section(F.col("value"), "SGTypes", "PETypes").alias("types"),
    )
    graphs = parsed.select("graph_id", "ref", "strand", "left", "right", "read_count")
    tab = F.split("line", "\t")
    segments = parsed.select("graph_id", F.posexplode("segs").alias("idx", "line")).select("graph_id", "idx", tab[0].cast("int").alias("start"), tab[1].cast("int").alias("end"), tab[7].cast("double").alias("zero_frac"))
    words = F.filter(F.split("line", r"\s+"), lambda x: F.length(x) > 0)
    rows = parsed.select("graph_id", F.posexplode("types").alias("row", "line")).withColumn("words", words)
    path_rows = rows.select("graph_id", "row", F.transform(F.slice("words", F.lit(1), F.size("words") - 1), lambda x: x.cast("int")).alias("flags"), F.element_at("words", -1).cast("long").alias("n"))
    return graphs, segments, path_rows


def to_text(graphs: DataFrame, segments: DataFrame, path_rows: DataFrame) -> DataFrame:
    """The graphs as instance text, one row ``value`` each, which read_instances() reads back."""
    text = lambda *c: F.concat_ws("\t", *[F.col(x).cast("string") if isinstance(x, str) else x for x in c])
    zero = F.lit("0")
    listed = lambda df, key, line, name: df.groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, line.alias("line")))), lambda x: x["line"]), "\n").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    segs = listed(segments, "idx", text("start", "end", zero, zero, zero, zero, zero, "zero_frac"), "segs")
    flags = F.array_join(F.transform("flags", lambda x: x.cast("string")), " ")
    rows = listed(path_rows, "row", F.concat_ws(" ", flags, F.col("n").cast("string")), "rows")
    parts = [
        text(F.lit("Instance"), "graph_id"), F.concat_ws(" ", F.lit("Boundary\t"), "ref", F.col("left").cast("string"), F.col("right").cast("string"), "strand"), text(F.lit("Reads"), "read_count"),
        text(F.lit("Segs"), "n_segs"), F.col("segs"), F.lit("Refs\t0"), text(F.lit("SGTypes"), "n_rows"), F.col("rows"), F.lit("PETypes\t0 0"),
    ]
    return graphs.join(segs, "graph_id").join(rows, "graph_id").select(F.concat_ws("\n", *parts).alias("value"))


def read_instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reads a file split at the word Instance, so that records are dealt over tasks."""
    return from_text(spark.read.option("lineSep", "Instance").text(path))
