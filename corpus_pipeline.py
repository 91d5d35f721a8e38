"""The corpus pipeline: STAGES applied in turn to the documents, each reading what the last one wrote.

Every stage but the last returns rows with the columns of documents. Rows without a
letter of any language go at the first; a document all of whose lines repeat earlier
ones goes at the second; of a group of near duplicates (five-word shingles, similarity 0.8)
the one with the smallest doc_id stays; documents with a passage of a benchmark item go.

In all stages: columns beside those of documents pass through, whatever their names, and
an empty table gives an empty one. Rows with a null doc_id or one that other rows have
too are told apart by their texts, so nothing is decided for one row by the text of another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm import decontam, jaccard, langid, linededup, mixing
from helixloom.llm._shared import join_small, written

#: A language predicted with a lower score than this is as good as none.
LEAST_SCORE = 0.3
#: Keys of rows whose doc_id doesn't tell them apart start here, behind all ids.
_OWN = 1 << 62


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns named like these renamed, and the way back."""
    clash = {c: f"__own_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(clash), {v: k for k, v in clash.items()}


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with __key (doc_id, or a hash of id and text where the id is null or not unique) and __twice."""
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id", F.lit(True).alias("__twice"))
    marked = join_small(docs, written(twice, "pipeline-shared-ids"), ["doc_id"], "left")
    own = F.lit(_OWN) + F.pmod(F.xxhash64("doc_id", F.col("text").cast("string")), F.lit(_OWN))
    return marked.withColumn("__key", F.when(F.col("__twice"), own).otherwise(F.col("doc_id").cast("long")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from two thirds of the labelled rows.

    A null text or one without a letter has no language and goes; rows with a null lang
    are judged like any other. Equal texts fare alike. Without a labelled row nothing stays.
    """
    model = langid.fit(docs.filter(langid.fold(3) != 1))
    held, back = _aside(docs, ["lang_pred", "score"])
    found = langid.identify(held, model, held.columns)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score").withColumnsRenamed(back).select(docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; n_chars, where it is there, follows the text.

    A null or blank text has no lines and stays. Repeated rows of one doc_id and text are
    one document and stay both; with different ids the later one goes, if its lines are long or many enough.
    """
    held, back = _aside(docs, linededup.RESULTS)
    found = linededup.dedup_lines(held)
    left = found.filter((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.drop(*linededup.RESULTS).withColumnsRenamed(back).select(docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, an own one before null or shared ones.

    Null texts and texts without words are no one's duplicates and stay. Of rows with one doc_id
    and one text one stays, the same in every run.
    """
    rows = _keyed(docs)
    groups = jaccard.similar_groups(rows.select(F.col("__key").alias("doc_id"), "text"))
    gone = written(groups.filter("doc_id != component_id").select(F.col("doc_id").alias("__key")).distinct(), "pipeline-copies")
    left = join_small(rows, gone, ["__key"], "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    some = F.col("__twice") & (F.regexp_extract(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[^\x20\x09-\x0D]", 0) != "")
    again = left.filter(some).groupBy("__key").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return left.filter(~F.coalesce(some, F.lit(False))).select(docs.columns).unionByName(again)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    A null text has no passage and stays; every row with a passage goes, repeated or not. A long document
    that mentions an item of a few words stays.
    """
    rows = _keyed(docs)
    found = decontam.contaminated(rows.select(F.col("__key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = written(found.filter("NOT mention").select(F.col("doc_id").alias("__key")).distinct(), "pipeline-leaks")
    return join_small(rows, leaks, ["__key"], "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies that each kept document gets in the mix; the last stage.

    A null text has size 0, a null source is one of its own, and repeated rows are separate documents.
    """
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("mixing", mix_sources),
]

#: SQL can't express the first and the last stage; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
