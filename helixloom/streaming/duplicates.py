"""Duplicates collapsed over a stream of alignments, and released in the order of position.

Event time is the place in the references laid end to end, a second a base, so the
watermark is how far the stream has come: with ``delay`` bases of disorder allowed, all records left of
it have arrived. A group holds the records whose pair begins in one bin of a reference
and strand bucket: both mates know both places, so a pair and all its duplicates are in one group.
Its state is mates that wait, by name and places, and the best pair so far, by what makes
pairs duplicates: both as lists of packed pieces, as a step reads all of a group and a call for each entry costs far more. The frontier is the leftmost of the watermark and the mates that wait. No pair that
begins before it can still come, so those are put out, sorted; a mate that waits goes when
the watermark has passed where the other would be. What is put out later never begins further left.

An unplaced record (no position, as at the end of a sorted file) moves the watermark
behind everything, and then no state is left. A record later than the delay is dropped. Of three or more
records of one name and place those that are read one after another pair.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from helixloom.functions import cigar
from helixloom.operators import dedup
from helixloom.options import Options

_MATE = "struct<arrival:bigint,pos:int,mate_pos:int,cigar:array<struct<op:string,len:int>>,insert_size:int,qual:string,md:string,nh:int>"
_OUT = "ref string, bucket string, bin long, pos1 int, name string, hi int, a string, b string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = ("arrival", "pos", "mate_pos", "insert", "nh", "shape", "mate")


def add(waiting: dict[tuple, tuple], kept: dict[tuple, tuple], rows: Iterable[tuple[tuple, tuple]]) -> None:
    """Takes rows (key, fields) in: pairs those that point at each other and keeps the best pair of duplicates."""
    for key, row in rows:
        other = waiting.get(key)
        if other is None or other[1] != row[2] or other[2] != row[1]:
            waiting[key] = row
            continue
        del waiting[key]
        a, b = sorted((other, row), key=lambda r: r[0])
        place = (a[1], b[1], abs(a[3]), a[5], b[5])
        pair = (-1 if b[4] is None else int(b[4] != 1), b[0], key[0], key[1], a[6], b[6])
        if place not in kept or pair[:2] < kept[place][:2]:
            kept[place] = pair


def release(waiting: dict[tuple, tuple], kept: dict[tuple, tuple], now: int) -> tuple[list[tuple], list[tuple], int | None]:
    """Mates that wait in vain and places that are free, when all left of ``now`` has arrived; and where the next change can be."""
    gone = [k for k in waiting if k[3] < now]
    left = [k for k in waiting if k[3] >= now]
    frontier = min([now, *(k[2] for k in left)])
    free = sorted((p for p in kept if min(p[0], p[1]) < frontier), key=lambda p: (min(p[0], p[1]), kept[p][1]))
    begins = [min(p[0], p[1]) for p in kept]
    following = [x + 1 for x in [*(b for b in begins if b >= now), *(k[3] for k in left)]]
    return gone, free, min(following, default=None)


#: Entries of a group in one piece of its state.
PIECE = 4096


def packed(entries: dict[tuple, tuple]) -> list[tuple[bytes]]:
    """The entries in pieces of a bounded number."""
    items = list(entries.items())
    return [(zlib.compress(pickle.dumps(items[i : i + PIECE], pickle.HIGHEST_PROTOCOL), 1),) for i in range(0, len(items), PIECE)]


def unpacked(pieces: Iterable[tuple[bytes]]) -> dict[tuple, tuple]:
    return {k: v for piece, in pieces for k, v in pickle.loads(zlib.decompress(bytes(piece)))}


def plain(column: pd.Series) -> list:
    """The values of a column, None where there is none."""
    return column.tolist() if not (none := column.isna()).any() else column.astype(object).where(~none, None).tolist()


class Collapse(StatefulProcessor):
    """One group: (ref, bucket, offset of the reference, bin)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "piece binary")
        self.kept = handle.getListState("kept", "piece binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("arrival", kind="stable")
        columns = [plain(frame[c]) for c in ("name", "hi", *_FIELDS)]
        new = [
            ((name, int(hi), int(min(pos, mate_pos)), int(max(pos, mate_pos))), (int(arrival), int(pos), int(mate_pos), int(insert), None if nh is None else int(nh), shape, mate))
            for name, hi, arrival, pos, mate_pos, insert, nh, shape, mate in zip(*columns, strict=True)
        ]
        yield from self._step(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, [], timerValues)

    def _step(self, key, new, timers) -> Iterator[pd.DataFrame]:
        waiting, kept = (unpacked(s.get()) if s.exists() else {} for s in (self.waiting, self.kept))
        add(waiting, kept, new)
        offset = int(key[2])
        gone, free, following = release(waiting, kept, timers.getCurrentWatermarkInMs() // 1000 - offset)
        out = [(key[0], key[1], int(key[3]), min(p[0], p[1]), *kept[p][2:]) for p in free]
        for k in gone:
            del waiting[k]
        for p in free:
            del kept[p]
        for state, entries, changed in ((self.waiting, waiting, new or gone), (self.kept, kept, new or free)):
            if changed and entries:
                state.put(packed(entries))
            elif changed and state.exists():
                state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(t[0]) if isinstance(t, tuple) else int(t))
        if following is not None:
            self.handle.registerTimer((offset + following) * 1000)
        if out:
            yield pd.DataFrame(out, columns=["ref", "bucket", "bin", "pos1", "name", "hi", "a", "b"])

    def close(self) -> None:
        pass


def collapse_stream(alignments: DataFrame, references: list[tuple[str, int]], options: Options | None = None, delay: int = 0, width: int = 1 << 14) -> DataFrame:
    """Deduplicated pairs of a streaming table of alignments: ref, bucket, bin, pos1, name, hi, a, b.

    references: names and lengths in the order of the file. A bin of ``width`` bases is
    a group; with a width beyond the longest reference a strand is put out in one order, as one task's work.
    """
    options, spark = options or Options(), alignments.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    offsets, total = [], 0
    for name, length in references:
        offsets.append((name, total))
        total += length + 1
    table = spark.createDataFrame(offsets, "__ref string, offset long")
    known = alignments.join(F.broadcast(table), alignments["ref"] == table["__ref"], "left").drop("__ref")
    # What is at the watermark counts as late, so a place is one second further and the delay one longer.
    at = F.timestamp_seconds(F.coalesce(F.when(F.col("pos") >= 0, F.col("offset") + F.col("pos") + 1), F.lit(total + delay + 3)))
    timed = known.withColumn("at", at).withWatermark("at", f"{delay + 1} seconds").withColumn("bucket", dedup.strand_bucket(options))
    wanted = dedup.is_mapped_pair() & dedup.is_proper(options.max_insert) & F.col("bucket").isNotNull() & cigar.supported(F.col("cigar"))
    # All records move the watermark; a filter that doesn't ask for the event time would be pushed below it.
    records = timed.filter(wanted | (F.col("at") < F.timestamp_seconds(F.lit(-(10**9)))))
    mate = F.to_json(F.struct(*dedup.MATE))
    low = F.least("pos", "mate_pos")
    rows = records.select(
        "ref", "bucket", "offset", F.floor(low / width).cast("long").alias("bin"), "name", F.coalesce("hi", F.lit(0)).alias("hi"), "arrival", "pos", "mate_pos", F.col("insert_size").alias("insert"), "nh", cigar.normalised(F.col("cigar")).alias("shape"), mate.alias("mate"), "at",
    )
    found = rows.groupBy("ref", "bucket", "offset", "bin").transformWithStateInPandas(Collapse(), _OUT, "append", "eventTime")
    return found.withColumns({c: F.from_json(c, _MATE) for c in "ab"})


def write_sorted(pairs: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each batch of pairs in order, below a folder of its number; a batch that is tried again replaces its folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.repartitionByRange("ref", "bucket", "pos1").sortWithinPartitions("ref", "bucket", "pos1").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pairs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
