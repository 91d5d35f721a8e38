"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Documents with equal sets are one class from the start, so copies meet nowhere below.
Small sets enumerate, for every partner size, all their subsets of the overlap that the
threshold asks for; sets with a subset in common are linked without further comparison.
Large sets, and small ones that can reach them, go into inverted lists. Lists are
ordered from rare to frequent shingles (by a count sketch over the whole corpus) and a set enters
only the lists of its rarest shingles, as many as a partner must hit at least once. The
boundary between small and large is where enumerating subsets costs more than lists do.

Candidates of a list are compared in two rounds. First with the list's leader for their
size, which links most of a group of near copies; then, in lists that still hold several
components, with the members of other components, where one side is outside the list's
leading component. Pairs inside a component are never formed, so a group of copies
costs in proportion to its size, and no link between components is lost. Of lists with
the same members only the one of the rarest shingle is looked at in the second round: it
is the first in which they meet. Candidates are compared by whole sets of 48-bit hashes.

Shingles that the sketch shows in very many documents are dealt over several tasks, each
part of which learns the leader of the whole list.

Nulls and ties: null text, or text without a word, has the empty set and no links. Rows
that share a doc_id are versions of one document and belong to one component; a null
doc_id sorts first and shows as null. Empty tables are fine; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm._shared import discard, join_counted, join_small, written
from helixloom.llm._text import chunks, grams, lower, mix64, per_row, span_hashes, words
from helixloom.llm.components import components

#: Counters of the sketch, in blocks, and bits of the filter for documents to compare (8 MB).
SKETCH_BITS = 20
_BLOCK = 4096
FILTER_BITS = 26
#: Members of a list that go to one task in the first round.
LIST_ROWS = 1024
#: Sets compared with one leader in one task.
FAN = 256
#: What a place in an inverted list costs, comparisons included, if a subset costs 1.
LIST_COST = 9
_NO_ID = -(1 << 63)
_ID = f"coalesce(cast(doc_id as bigint), {_NO_ID} )".replace(str(_NO_ID), "-9223372036854775808")


@dataclass(frozen=True)
class Measure:
    """Shingles of so many words, linked when 100 * common >= percent * union."""

    words: int = 5
    percent: int = 80

    def overlap(self, n: int, m: int) -> int:
        """The least number of common elements of linked sets of these sizes."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def partners(self, n: int) -> range:
        """Sizes of the sets that one of size n can be linked with."""
        return range(-(-self.percent * n // 100), 100 * n // self.percent + 1)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Places from which at least one must be shared with a partner."""
        return n - -(-self.percent * n // 100) + 1

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, self.overlap(n, m)) for m in self.partners(n))


def shingles(raw: np.ndarray, offsets: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles, sorted by both."""
    low = lower(raw)
    starts, ends, first = words(low, offsets)
    token = span_hashes(low, starts, ends)
    full, at = grams(token, first, n_words)
    keys, rows = [full], [np.searchsorted(first, at, side="right") - 1]
    for k in range(1, n_words):
        short = np.flatnonzero(np.diff(first) == k)
        if len(short):
            total = np.full(len(short), k, np.uint64)
            for i in range(k):
                total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + token[first[short] + i])
            keys.append(total)
            rows.append(short)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[new], key[new]


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def profile(docs: DataFrame, measure: Measure) -> DataFrame:
    """For each document its set's size and two sums that identify the set; and parts of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "counts", "node", "n", "s1", "s2"]
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                row, key = shingles(raw, offsets, measure.words)
                sketch += np.bincount(_slot(key), minlength=len(sketch)).astype(np.int32)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                sums = [pa.array(per_row(mix64(key + np.uint64(s)), bounds).view(np.int64)) for s in (1, 2)]
                nulls = [pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([*nulls, part.column("node"), pa.array(np.diff(bounds), pa.int64()), *sums], names)
        blocks = sketch.reshape(-1, _BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        empty = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_squeezed(blocks[i]) for i in some], pa.binary()), empty, empty, empty, empty], names)

    picked = docs.select(F.expr(_ID).alias("node"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "block int, counts binary, node long, n long, s1 long, s2 long")


def _squeezed(values: np.ndarray) -> bytes:
    """Compressed, byte planes apart."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def _sketch(parts: DataFrame) -> np.ndarray:
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, np.int64)
        for chunk in table.column("counts").chunks:
            for x in chunk:
                planes = np.frombuffer(pa.decompress(x.as_py(), 4 * _BLOCK, codec="zstd", asbytes=True), np.uint8)
                total += np.ascontiguousarray(planes.reshape(4, _BLOCK).T).view(np.int32).ravel()
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((1 << SKETCH_BITS) // _BLOCK * _BLOCK, np.int64).reshape(-1, _BLOCK)
    for row in parts.groupBy("block").applyInArrow(add, "block int, counts binary").toArrow().to_pylist():
        out[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return out.ravel()


def least_listed(small: int, measure: Measure) -> int:
    """The size from which sets are listed if those up to ``small`` are enumerated: they can reach a larger one."""
    return -(-measure.percent * (small + 1) // 100)


def boundary(sizes: dict[int, int], measure: Measure) -> int:
    """The size up to which sets are enumerated at the least cost for these numbers of sets of each size.

    The cost is that of all subsets of the small sets with partners among them, and of all
    list places of the sets that can be linked with a large one; sets on either side of the
    boundary that can reach each other pay for lists, and the small ones for both.
    """
    costs = []
    for small in range(max(sizes, default=0) + 1):
        least = least_listed(small, measure)
        light = sum(c * math.comb(n, measure.overlap(n, m)) for n, c in sizes.items() if n <= small for m in measure.partners(n) if m <= small)
        heavy = sum(c * int(measure.prefix(np.array([n]))[0]) for n, c in sizes.items() if n >= least)
        costs.append((light + LIST_COST * heavy, small))
        if light > LIST_COST * sum(c * n for n, c in sizes.items()):
            break
    return min(costs)[1] if costs else 0


def listed(docs: DataFrame, measure: Measure, sketch: np.ndarray, least: int, small: int) -> DataFrame:
    """node, n, s1, the rarest shingles of sets of at least ``least``, salts if some are in very many documents, and keys of subsets of sets up to ``small``."""
    held = docs.sparkSession.sparkContext.broadcast(sketch.astype(np.int32))
    usual = float(np.median(sketch))
    many = max(LIST_ROWS, 8 * math.sqrt(usual))  # what other shingles add to a counter varies by the root of it

    def subset_keys(n: int, key: np.ndarray) -> list[tuple[int, int, int]]:
        with np.errstate(over="ignore"):
            each = mix64(key)
            total = each.sum(dtype=np.uint64)
            out = []
            for m in measure.partners(n):
                if m > small:
                    continue
                drop = n - measure.overlap(n, m)
                for gone in combinations(range(n), drop):
                    left = mix64(np.array([total - each[list(gone)].sum(dtype=np.uint64)], np.uint64))[0]
                    out.append((min(n, m), max(n, m), int(np.array(left).view(np.int64))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64())]))
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                row, key = shingles(raw, offsets, measure.words)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                n = np.diff(bounds)
                s1 = per_row(mix64(key + np.uint64(1)), bounds).view(np.int64)
                order = np.lexsort((key, held.value[_slot(key)], row))
                ranked = key[order]
                take = np.where(n >= max(least, 1), measure.prefix(n), 0)
                place = np.arange(len(row)) - bounds[:-1][row]
                prefix = ranked[place < take[row]]
                of = row[place < take[row]]
                excess = held.value[_slot(prefix)] - usual
                parts = np.where(excess > many, np.ceil(excess / LIST_ROWS), 1).astype(np.uint64)
                node = mix64(part.column("node").to_numpy().view(np.uint64) + np.uint64(1))
                salt = (node[of] % parts).astype(np.int32)
                at = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
                hot = np.zeros(part.num_rows, bool)
                hot[of[parts > 1]] = True
                salt_at = np.concatenate([[0], np.cumsum(np.where(hot, take, 0))]).astype(np.int32)
                salt = np.where(parts > 1, salt, -1).astype(np.int32)[hot[of]]
                subsets = [subset_keys(int(n[i]), key[bounds[i] : bounds[i + 1]]) if 0 < n[i] <= small else [] for i in range(part.num_rows)]
                subsets = [[{"lo": a, "hi": b, "key": k} for a, b, k in x] for x in subsets]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(n, pa.int64()), pa.array(s1), pa.ListArray.from_arrays(pa.array(at), pa.array(prefix.view(np.int64))), pa.ListArray.from_arrays(pa.array(salt_at), pa.array(salt)), pa.array(subsets, kind)], ["node", "n", "s1", "prefix", "salts", "subsets"])

    picked = docs.select(F.expr(_ID).alias("node"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "node long, n long, s1 long, prefix array<long>, salts array<int>, subsets array<struct<lo:int,hi:int,key:long>>")


def _filter(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that has the bits of these nodes set; its words are put together before they are fetched."""
    bit = F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS))
    words = nodes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, 31 - cast(bit % 32 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), ">u4")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _squeezed_steps(step: np.ndarray) -> bytes:
    """48-bit numbers, byte planes apart and compressed: of the steps of a large set the high bytes are few."""
    planes = np.ascontiguousarray(step.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def verify(docs: DataFrame, pairs: DataFrame, measure: Measure) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough, by sets sent to the place of a.

    The sets compared with one a are dealt out over several tasks, FAN in each, and the
    set of a comes first in each; a task holds that set and one batch.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("fan")).filter(F.col("fan") > FAN)
    dealt = join_small(pairs, many, ["a"], "left")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("fan") / FAN), F.lit(1))).cast("int").alias("salt"))
    dealt = written(dealt, "jaccard-pairs")
    wants = dealt.select(F.col("b").alias("node"), F.col("a").alias("to"), "salt", F.lit(1).alias("own")).unionByName(dealt.select(F.col("a").alias("node"), F.col("a").alias("to"), "salt", F.lit(0).alias("own")).distinct())
    wants = written(wants, "jaccard-wants")
    held = docs.sparkSession.sparkContext.broadcast(_filter(wants))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((held.value[bit >> 3] >> (7 - (bit & 7)) & 1).astype(bool)))
            for part, raw, offsets in chunks(batch):
                row, key = shingles(raw, offsets, measure.words)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                step = np.diff(key >> np.uint64(16), prepend=np.uint64(0))  # sorted inside a row
                step[bounds[:-1][bounds[:-1] < len(key)]] = (key >> np.uint64(16))[bounds[:-1][bounds[:-1] < len(key)]]
                values = [_squeezed_steps(step[bounds[i] : bounds[i + 1]]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(bounds), pa.int64()), pa.array(values, pa.binary())], ["node", "n", "items"])

    def unpack(n: int, items: bytes) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        if n:
            out[:, :6] = np.frombuffer(pa.decompress(items, 6 * n, codec="zstd", asbytes=True), np.uint8).reshape(6, n).T
        return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {"of": None, "sets": []}
        for batch in batches:
            found = []
            for to, salt, kind, node, n, items in zip(*(batch.column(c).to_pylist() for c in ("to", "salt", "own", "node", "n", "items")), strict=True):
                mine = unpack(n, items)
                if own["of"] != (to, salt):
                    own = {"of": (to, salt), "sets": []}
                if kind == 0:
                    own["sets"].append(mine)
                    continue
                for base in own["sets"]:  # more than one only where rows share a doc_id
                    both = len(np.intersect1d(base, mine, assume_unique=True))
                    if 100 * both >= measure.percent * (len(base) + len(mine) - both):
                        found.append((to, node))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    picked = docs.select(F.expr(_ID).alias("node"), F.col("text").cast("string").alias("text")).withColumn("bit", F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS)))
    asked = picked.mapInArrow(sets, "node long, n long, items binary").join(wants.hint("shuffle_hash"), "node").select("to", "salt", "own", "node", "n", "items")
    return asked.repartition("to", "salt").sortWithinPartitions("to", "salt", "own").mapInArrow(compare, "a long, b long").distinct()


def _possible(measure: Measure, n: str, i: str, m: str, j: str):
    """Whether sets of sizes n and m that first meet at places i and j can be similar enough."""
    need = F.ceil(F.lit(measure.percent) * (F.col(n) + F.col(m)) / F.lit(100 + measure.percent))
    return F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= need


def similar_groups(docs: DataFrame, measure: Measure | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    measure = measure or Measure()
    found = written(profile(docs, measure), "jaccard-profile")
    nodes = found.filter("node IS NOT NULL").select("node", "n", "s1", "s2")
    sketch = _sketch(found.filter("block IS NOT NULL").select("block", "counts"))
    sizes = {r["n"]: r["count"] for r in nodes.filter("n BETWEEN 1 AND 64").groupBy("n").count().collect()}
    small = boundary(sizes, measure)
    least = least_listed(small, measure)

    classes = nodes.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("node").alias("first"))
    classes = written(classes, "jaccard-classes")
    equal = nodes.filter("n > 0").join(classes, ["n", "s1", "s2"]).filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))

    lists = listed(docs, measure, sketch, least, small)
    firsts = classes.select(F.col("first").alias("node"), "n", "s1")
    lists = written(lists.join(firsts.hint("shuffle_hash"), ["node", "n", "s1"], "left_semi").dropDuplicates(["node", "n", "s1"]), "jaccard-lists")

    keys = lists.filter(F.size("subsets") > 0).select("node", "n", F.explode("subsets").alias("s")).select("node", "n", "s.lo", "s.hi", "s.key").distinct()
    centres = keys.filter("n = lo").groupBy("lo", "hi", "key").agg(F.min("node").alias("a"))
    light = keys.join(centres, ["lo", "hi", "key"]).filter("node != a").select("a", F.col("node").alias("b")).distinct()
    light = written(light.unionByName(equal), "jaccard-light")

    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / measure.percent)).cast("int")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = lists.select("node", "n", "salts", F.posexplode("prefix").alias("i", "shingle")).select("node", "n", "i", "shingle", F.coalesce(F.get("salts", F.col("i")), F.lit(-1)).alias("salt"))
    places = places.repartition(parts, "shingle", "salt")
    # One exchange by shingle serves all windows. A list of two in one band is done with when its members have met.
    whole, near = Window.partitionBy("shingle", "salt"), Window.partitionBy("shingle", "salt", "band")
    lead = F.min(F.struct("node", F.col("n").alias("m"), F.col("i").alias("j"))).over(near)
    head = F.min("node").over(whole)
    met = places.withColumn("band", band).withColumn("lead", lead).withColumn("near", F.count(F.lit(1)).over(near)).withColumn("members", F.count(F.lit(1)).over(whole)).withColumn("head", head).withColumn("who", F.bit_xor(F.xxhash64("node")).over(whole)).withColumn("also", F.bit_xor(F.xxhash64("n", "node")).over(whole)).filter("members > 1 OR salt >= 0")
    opened = (F.col("near") != 2) | (F.col("members") != 2) | (F.col("salt") >= 0)
    shared = met.select("shingle", "node", "n", "i", opened, F.col("lead.node").alias("a"), "lead.m", "lead.j", F.col("node") == F.col("head"), "members", "who", "also", "salt").toDF("shingle", "node", "n", "i", "open", "a", "m", "j", "heads", "members", "who", "also", "salt")
    shared = written(shared, "jaccard-shared")
    discard(lists)
    # A list that was dealt out has one leader for all its parts, which goes to each of them.
    dealt = shared.filter("salt >= 0").withColumn("band", band)
    parts_of = dealt.filter("node = a").select("shingle", "band", "salt", "node", "n", "i")
    first = parts_of.groupBy("shingle", "band").agg(F.min(F.struct("node", F.col("n").alias("m"), F.col("i").alias("j"))).alias("first"))
    first = parts_of.join(first, ["shingle", "band"]).select("shingle", "band", "salt", "first")
    met = dealt.join(first, ["shingle", "band", "salt"]).select("node", "n", "i", F.col("first.node").alias("a"), "first.m", "first.j")
    met = met.unionByName(shared.filter("salt < 0").select("node", "n", "i", "a", "m", "j"))
    first_pairs = met.filter((F.col("node") != F.col("a")) & _possible(measure, "n", "i", "m", "j")).select("a", F.col("node").alias("b")).distinct()
    first_pairs = written(first_pairs, "jaccard-pairs")
    heavy = verify(docs, first_pairs, measure)
    links = written(light.unionByName(heavy).distinct(), "jaccard-links")

    of = components(links)
    # One list of those with the same members: places follow one order everywhere, so the first for one member is first for all.
    same = shared.filter("open AND heads AND salt < 0").groupBy("members", "who", "also").agg(F.min(F.struct("i", "shingle")).alias("kept")).select("kept.shingle")
    same = same.unionByName(shared.filter("open AND salt >= 0").select("shingle").distinct())
    few = shared.filter("open").select("shingle", "node", "n", "i").join(same, "shingle", "left_semi")
    placed = written(few.join(of, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-placed")
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.mode("component", True).alias("main"), F.count(F.lit(1)).alias("rows")).filter("lo != hi").select("shingle", "main", "rows")
    mixed = written(mixed, "jaccard-lists")
    mixed = written(join_counted(placed, mixed, ["shingle"], "rows"), "jaccard-mixed")
    discard(placed, shared)
    outside = mixed.filter("component != main").select("shingle", F.col("node").alias("a"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("component").alias("other"))
    crossing = mixed.join(outside, "shingle").filter("component != other AND (component = main OR node < a)").filter(_possible(measure, "n", "i", "m", "j"))
    second = crossing.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    done = first_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = written(second.join(done, ["a", "b"], "left_anti"), "jaccard-pairs")
    discard(mixed)
    if second.head(1):
        links = links.unionByName(verify(docs, second, measure)).distinct()
        of = components(links)
    out = nodes.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    shown = lambda c: F.when(F.col(c) != F.expr("-9223372036854775808"), F.col(c))
    return out.select(shown("node").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component").alias("component_id"))
