"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words. A document's expected number of copies is
target / source size; its whole part is taken for certain and the fraction is a copy
probability. Pairs of fractional documents of one source transfer probability mass,
weighted by their sizes, until one of the two is 0 or 1, so that the expected words of
the source never change; what is left over of a chunk of documents goes up a reduction
tree of fixed fan-in until one fractional document of each source remains; that one is rounded to the nearer,
and documents of the last group are turned over as long as that cancels more of what the rounding left.

Nulls and ties: null text has size 0 and null source is a source of its own, ordered
last. Repeated rows are separate documents in the result; on the way those of one doc_id, source
and text are one row with their number, since as many of them as their probabilities
add up to can be taken whichever they are, and only what is left over is drawn. Documents of size 0, or with a null
doc_id, take part like any other (the draw depends on doc_id, text and size only). An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm._shared import join_small, written
from helixloom.llm._text import chunks, words

#: Documents of one leaf of the reduction tree, on average, and children of an inner node.
CHUNK_ROWS = 256
FAN_IN = 64
#: Repeated rows that one task puts out.
BLOCK_ROWS = 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, a hash of the text and its number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                first = words(raw, offsets)[2]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("mark"), pa.array(np.diff(first), pa.int64())], ["doc_id", "source", "mark", "size"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(count, "doc_id long, source string, mark long, size long")


def _running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Rows with ``place`` in the order, from 0, and for each of ``sums`` what rows before them add up to, as ``before_``.

    Rows are dealt by ranges of the order, and a range learns what precedes it from one row for each range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "mix-ranges")
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).cast("double").alias(f"__{c}") for c in sums])
    per = per.select("__range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("__n", *[f"__{c}" for c in sums])])
    inside = Window.partitionBy("__range").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(F.broadcast(per), "__range").withColumn("place", F.row_number().over(inside) - 1 + F.col("__n"))
    for c in sums:
        found = found.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(so_far), F.lit(0)) + F.col(f"__{c}"))
    return found.drop("__range", "__n", *[f"__{c}" for c in sums])


def allocate(per_source: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Targets by weight, none above cap times its source, the excess shared again by weight.

    Sharing again and again ends where every source has min(cap * size, level * weight)
    with one level for all; sources in the order of cap * size / weight fill up in turn,
    so the level follows from running sums over the table of sources.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = _running(per_source, [F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8")], []).withColumnRenamed("place", "source_no")
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int"))).withColumn("full", F.lit(float(cap)) * F.col("source_size"))
    filled = _running(ranked, [F.col("full") / F.col("weight"), F.col("source_no")], ["full", "weight"])
    words, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(words or 0) * share) - F.col("before_full")) / (F.lit(weight or 0.0) - F.col("before_weight"))
    # The first source that does not fill up sets the level; counting later ones as full would lower it.
    best = filled.agg(F.max(F.when(level * F.col("weight") <= F.col("full"), level))).first()[0]
    target = F.col("full") if best is None else F.least(F.col("full"), F.lit(best) * F.col("weight"))
    return ranked.withColumn("target", target).drop("full", "weight")


def _uniform(seed: int, a: int, b: int, size: int) -> float:
    x = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB + size) & 0xFFFFFFFFFFFFFFFF
    for shift in (30, 27, 31):
        x = ((x ^ (x >> shift)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    return (x >> 11) / float(1 << 53)


def settle(ids: list[int], size: list[int], p: list[float], seed: int) -> tuple[list[float], int]:
    """Rounds all but at most one of p to 0 or 1, keeping sum(size * p): new p and the place of the rest, or -1."""
    p, open_at = list(p), -1
    for j, now in enumerate(p):
        if now <= 0.0 or now >= 1.0 or size[j] <= 0:
            p[j] = 1.0 if now >= 1.0 else 0.0
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        up_ends, up_i = (1.0 - p[i]) * size[i], p[j] * size[j]
        up = min(up_ends, up_i)
        down_i, down_j = p[i] * size[i], (1.0 - p[j]) * size[j]
        down = min(down_i, down_j)
        if _uniform(seed, ids[i], ids[j], size[j]) * (up + down) < down:
            if up_ends <= up_i:
                p[i], p[j], open_at = 1.0, p[j] - up / size[j], j
            else:
                p[i], p[j] = p[i] + up / size[i], 0.0
        elif down_i <= down_j:
            p[i], p[j], open_at = 0.0, p[j] + down / size[j], j
        else:
            p[i], p[j] = p[i] - down / size[i], 1.0
        k = open_at
        if not 1e-12 < p[k] < 1.0 - 1e-12:
            p[k], open_at = (1.0 if p[k] > 0.5 else 0.0), -1
    return p, open_at


def balance(size: list[int], before: list[float], after: list[float]) -> list[float]:
    """The settled p with documents that were fractions before turned over, two at most at a time, as long as that brings the words taken nearer to those expected."""
    s, p = np.array(size, np.float64), np.array(after)
    free = np.flatnonzero((np.array(before) > 0) & (np.array(before) < 1) & (s > 0))
    for _ in range(len(free)):
        miss = float((s * (np.array(before) - p)).sum())
        change = np.concatenate([np.where(p[free] > 0.5, -s[free], s[free]), [0.0, 0.0]])
        both = np.abs(miss - change[:, None] - change[None, :])
        np.fill_diagonal(both, np.inf)
        i, j = np.unravel_index(int(np.argmin(both)), both.shape)
        if both[i, j] >= abs(miss) - 1e-9:
            break
        turned = [free[k] for k in (i, j) if k < len(free)]
        p[turned] = 1.0 - p[turned]
    return p.tolist()


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Copies of each document: doc_id, source, size, source_size, target, copies, taken.

    The words taken of a source differ from its target by less than its largest document.
    """
    sized = written(sizes(docs).groupBy("doc_id", "source", "mark", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = written(allocate(per, weights, share, cap), "mix-targets")
    most = targets.agg(F.max("source_rows")).first()[0] or 0
    rows = join_small(sized, targets, ["source"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    n_chunks = F.ceil(F.col("source_rows") / chunk_rows)
    rows = rows.withColumn("expected", F.least(expected, F.lit(float(cap)))).withColumn("base", F.floor("expected").cast("long")).withColumn("p", (F.col("expected") - F.col("base")) * F.col("n"))
    rows = rows.withColumn("sure", F.floor("p").cast("long")).withColumn("p", F.col("p") - F.col("sure"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "mark")).withColumn("chunk", F.pmod(F.xxhash64("key"), n_chunks)).withColumn("open", F.lit(True)).drop("expected", "source_rows", "mark")
    schema = rows.schema

    def level(part: DataFrame, number: int, last: bool) -> DataFrame:
        def round_group(table: pa.Table) -> pa.Table:
            table = table.sort_by([("size", "descending"), ("key", "ascending")])
            ids = table.column("key").to_pylist()
            size, before = table.column("size").to_pylist(), table.column("p").to_pylist()
            p, rest = settle(ids, size, before, seed + number)
            if last:
                if rest >= 0:
                    p[rest], rest = float(p[rest] >= 0.5), -1
                p = balance(size, before, p)
            left = np.zeros(len(p), bool)
            if rest >= 0:
                left[rest] = True
            table = table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))
            return table.set_column(table.schema.get_field_index("open"), "open", pa.array(left))

        return part.groupBy("source_no", "chunk").applyInArrow(round_group, schema)

    now, number = -(-most // chunk_rows), 0
    out = written(level(rows, 0, now <= 1), "mix-rounded")
    done = out.filter(~F.col("open"))
    while now > 1:
        now, number = -(-now // FAN_IN), number + 1
        left = out.filter("open").withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("long"))
        out = written(level(left, number, now <= 1), "mix-rounded")
        done = done.unionByName(out.filter(~F.col("open")))
    blocks = done.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK_ROWS))))
    blocks = blocks.filter(F.col("n") <= BLOCK_ROWS).unionByName(blocks.filter(F.col("n") > BLOCK_ROWS).repartition("key", "block"))
    each = blocks.withColumn("j", F.explode(F.sequence(F.col("block") * BLOCK_ROWS, F.least("n", (F.col("block") + 1) * BLOCK_ROWS) - 1)))
    copies = (F.col("base") + (F.col("j") < F.col("sure") + F.col("p").cast("long")).cast("long")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
