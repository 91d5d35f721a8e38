"""Alignments from SAM text or Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.functions import cigar


def _tag(fields: Column, name: str) -> Column:
    found = F.filter(fields, lambda f: f.startswith(f"{name}:"))
    return F.regexp_extract(F.try_element_at(found, F.lit(1)), r"^..:.:(.*)$", 1)


def from_sam_lines(lines: DataFrame) -> DataFrame:
    """The alignment table of SAM lines in a column ``value``; header lines are left out.

    arrival follows the order of the file as Spark reads it: partition, then line.
    """
    fields = F.split("value", "\t")
    flag = F.get(fields, F.lit(1)).cast("int")
    bit = lambda b: flag.bitwiseAND(b) != 0
    at = lambda i: F.get(fields, F.lit(i))
    rows = lines.filter(~F.col("value").startswith("@") & (F.length("value") > 0)).withColumn("arrival", F.monotonically_increasing_id())
    tag = lambda n: _tag(F.slice(fields, 12, 1 << 20), n)
    return rows.select(
        at(0).alias("name"), at(2).alias("ref"), (at(3).cast("int") - 1).alias("pos"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mate_ref"), (at(7).cast("int") - 1).alias("mate_pos"), at(8).cast("int").alias("insert_size"),
        cigar.parse(at(5)).alias("cigar"), at(10).alias("qual"),
        bit(1).alias("is_paired"), bit(512).alias("is_qcfail"), (~bit(4)).alias("is_mapped"), (~bit(256)).alias("is_primary"), (~bit(8)).alias("mate_mapped"),
        bit(16).alias("is_rev"), bit(32).alias("mate_rev"), bit(64).alias("is_first"),
        tag("NH").try_cast("int").alias("nh"), tag("HI").try_cast("int").alias("hi"), tag("MD").alias("md"), "arrival",
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return from_sam_lines(spark.read.text(path))


def store(alignments: DataFrame, path: str) -> None:
    """Parquet by reference and sorted by position, so that readers of a region skip row groups."""
    alignments.repartitionByRange("ref", "pos").sortWithinPartitions("ref", "pos").write.partitionBy("ref").parquet(path)
