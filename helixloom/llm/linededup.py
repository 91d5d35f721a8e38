"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that are not blank, each trimmed and hashed. A
run of lines that occurred earlier (in the order of doc_id, then line) is deleted if it
has MIN_LINES lines or MIN_WORDS words. Its windows are its parts of MIN_LINES lines, or
of fewer with MIN_WORDS words together; the least line hash of a window is its
fingerprint, so equal windows have the same one at the same place, and about every second line
is none. Fingerprints that stand at one place only drop out. The places of the others
are joined, and matches extended from the fingerprint both ways over the windows that it
is the minimum of: each extension is keyed by its content, and the first place of every
key is one minimum, so a run is compared with all its earlier holders, whatever stands
around it there, without forming pairs. Windows with an earlier holder are deleted; a
longer run is the union of its windows.

The first copy of a line is never deleted: what is deleted equals an earlier line.

Nulls and ties: null or blank text has no lines and stays as it is; a null doc_id comes
before all others. Rows with one doc_id and equal texts are one document and get the
same result; those with different texts are ordered by a hash of the text. Empty tables
are fine. Other columns of the input are kept; those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm._shared import discard, join_counted, written
from helixloom.llm._text import chunks, lines, mix64, per_row, span_hashes, words

MIN_LINES = 3
MIN_WORDS = 50
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_INK = "[^\\x20\\x09-\\x0D]"
_KEY = "coalesce(cast(doc_id as bigint), -9223372036854775808)"


def trimmed_lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the trimmed lines, where rows begin, and which lines are not blank."""
    starts, ends, first = lines(raw, offsets)
    ink = np.flatnonzero(~_BLANK[raw])
    low, high = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    some = low < high
    begin, end = starts.copy(), starts.copy()
    begin[some], end[some] = ink[low[some]], ink[high[some] - 1] + 1
    return begin, end, first, some


def windows(key: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of the lines: place of its fingerprint, start, size and hash of its content; in the order of fingerprints."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(key))
    total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    parts = []
    for n in range(1, MIN_LINES + 1):
        at = np.flatnonzero(left >= n)
        if n < MIN_LINES:
            at = at[total[at + n] - total[at] >= MIN_WORDS]
        code, least = np.full(len(at), n, np.uint64), at.copy()
        for i in range(n):
            code = mix64(code + key[at + i])
            least = np.where(key[at + i] < key[least], at + i, least)
        parts.append((least, at, np.full(len(at), n, np.int64), code))
    least, at, n, code = (np.concatenate([p[j] for p in parts]) for j in range(4))
    order = np.argsort(least, kind="stable")
    return least[order], at[order], n[order], code[order]


def fingerprints(docs: DataFrame) -> DataFrame:
    """fingerprint, doc, version, line (its place among the lines that are not blank) and the windows (code, shift, size) it is the minimum of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                begin, end, bounds, some = trimmed_lines(raw, offsets)
                word_starts = words(raw, offsets)[0]
                count = (np.searchsorted(word_starts, end) - np.searchsorted(word_starts, begin))[some]
                first = np.concatenate([[0], np.cumsum(per_row(some, bounds))])
                key = span_hashes(raw, begin[some], end[some])
                least, start, size, code = windows(key, count, first)
                head = np.flatnonzero(np.diff(least, prepend=-1))
                at = least[head]
                row = np.searchsorted(first, at, side="right") - 1
                of, cut = pa.array(row), pa.array(np.append(head, len(least)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(v)) for v in (code.view(np.int64), (start - least).astype(np.int32), size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), part.column("doc").take(of), part.column("version").take(of), pa.array((at - first[row]).astype(np.int32)), *lists], ["fingerprint", "doc", "version", "line", "codes", "shifts", "sizes"])

    text = F.col("text").cast("string")
    picked = docs.select(F.expr(_KEY).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    return picked.mapInArrow(run, "fingerprint long, doc long, version long, line int, codes array<long>, shifts array<int>, sizes array<int>")


def repeated(docs: DataFrame) -> DataFrame:
    """doc, version and lines: places, among its lines that are not blank, of what is repeated from earlier."""
    prints = written(fingerprints(docs), "line-prints")
    place = F.struct("doc", "version", "line")
    several = lambda df, key: df.groupBy(key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).filter("first != last").select(key, "first", "n")
    again = written(several(prints, "fingerprint").drop("first"), "line-again")
    met = join_counted(prints, again, ["fingerprint"], "n")
    each = met.select("doc", "version", F.col("line").alias("at"), F.explode(F.arrays_zip("codes", "shifts", "sizes")).alias("w"))
    extended = written(each.select(F.col("w.codes").alias("code"), "doc", "version", (F.col("at") + F.col("w.shifts")).alias("line"), F.col("w.sizes").alias("size")), "line-windows")
    discard(prints, again)
    firsts = written(several(extended, "code"), "line-firsts")
    later = join_counted(extended, firsts, ["code"], "n").filter(place != F.col("first"))
    spans = later.groupBy("doc", "version").agg(F.collect_set(F.struct("line", "size")).alias("spans"))
    lines = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["line"], s["line"] + s["size"] - 1))))
    found = written(spans.select("doc", "version", lines.alias("lines")), "line-spans")
    discard(extended, firsts)
    return found


RESULTS = ["n_lines", "n_removed"]


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with repeated runs deleted from text, and n_lines and n_removed (lines that are not blank)."""
    kept = docs.select([c for c in docs.columns if c not in RESULTS])
    text = F.col("text").cast("string")
    found = repeated(kept).select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("lines").alias("__lines"))
    keyed = kept.withColumn("text", text).withColumn("__k", F.expr(_KEY)).withColumn("__v", F.xxhash64(text))
    # The documents stream past their places, which are hashed: a small part of what the texts of a partition take. Cutting
    # stays in the JVM, so no task holds its texts sorted, in Arrow buffers or in a Python worker as well.
    joined = keyed.join(found.hint("shuffle_hash"), (F.col("__k") == F.col("__doc")) & (F.col("__v") == F.col("__version")), "left").drop("__k", "__v", "__doc", "__version")
    # Columns of their own, as what is used several times, or in a function, is to be worked out once for a document.
    split = joined.withColumn("__parts", F.split("text", "\n", -1)).withColumn("__ink", F.array_compact(F.transform("__parts", lambda x, i: F.when(x.rlike(_INK), i))))
    gone = F.transform("__lines", lambda p: F.get("__ink", p))
    left = split.withColumn("__left", F.when(F.col("__lines").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), gone)))
    cut = F.array_join(F.transform("__left", lambda i: F.get("__parts", i)), "\n")
    results = {"text": F.coalesce(cut, "text"), "n_lines": F.coalesce(F.array_size("__ink"), F.lit(0)), "n_removed": F.coalesce(F.array_size("__lines"), F.lit(0))}
    return left.withColumns(results).drop("__lines", "__parts", "__ink", "__left")
