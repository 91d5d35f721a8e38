"""BAM files as a Spark data source, for batches and streams: ``spark.read.format("bam").load(path)`` after ``register(spark)``.

BAM is a series of gzip members (BGZF blocks) of at most 64 KB, each of which says its
size, so a file is dealt over tasks by block offsets. A record may start in one block
and end in the next, and nothing marks where records start; the driver therefore reads the header
only, and a task whose range starts inside the file finds the first offset from which
CHAIN whole records follow one another, or all up to the end of the file. It then reads
the records that start in its range, following the last one into the next range.

The path is a file, a folder of files, or what write() left. A file with an index beside it (index() makes one)
is read only where the filters on ref and pos may hold. A stream goes forward by ``maxBytesPerTrigger``
of compressed blocks; how far it has ever gone is kept in the folder ``progress``,
so that a restart never goes back.
"""

from __future__ import annotations

import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from helixloom import schema
from helixloom.sources import blobs

SPLIT_BYTES = 64 << 20
_OPS = "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_INTS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_BLOCK = 1 << 16
#: Whole records in a row that a guess of where records start must be followed by.
CHAIN = 4
#: Bytes beyond which a guess is no record.
MOST_RECORD = 1 << 26


def block_size(head: bytes) -> int:
    """The size of the BGZF block that starts with ``head``, 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def _open(path: str):
    fs, name = blobs.filesystem(path)
    return fs.open_input_file(name)


def files_of(path: str) -> list[str]:
    """The BAM files of a path, in order: itself, those that write() committed there, or those of a folder."""
    fs, name = blobs.filesystem(path)
    if fs.get_file_info(name).type != pafs.FileType.Directory:
        return [path]
    folders = [f"/{f}" for f in blobs.committed(path)] or [""]
    return [f"{path.rstrip('/')}{f}/{x}" for f in folders for x in sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(name + f))) if x.endswith(".bam")]


def blocks(file, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the blocks from ``start`` on."""
    while start < size:
        raw = file.read_at(min(_BLOCK, size - start), start)
        n = block_size(raw)
        if not n:
            raise ValueError(f"no BGZF block at {start}")
        yield start, zlib.decompress(raw[:n], 31)
        start += n


def first_block(file, start: int, size: int) -> int:
    """The offset of the first block at or after ``start``; two in a row must be there, or the end."""
    raw = file.read_at(min(2 * _BLOCK, size - start), start)
    at = raw.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        n = block_size(raw[at : at + _BLOCK])
        if n and (start + at + n == size or block_size(file.read_at(min(_BLOCK, size - start - at - n), start + at + n))):
            return start + at
        at = raw.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


def header(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """Names and lengths of references, and where the first record is: block offset and place in the block."""
    with _open(path) as file:
        data, starts = b"", []
        for offset, content in blocks(file, 0, file.size()):
            starts.append((len(data), offset))
            data += content
            if len(data) < 12:
                continue
            at = 8 + struct.unpack_from("<i", data, 4)[0]
            if len(data) < at + 4:
                continue
            n, = struct.unpack_from("<i", data, at)
            at, found = at + 4, []
            while len(found) < n and len(data) >= at + 4:
                size, = struct.unpack_from("<i", data, at)
                if len(data) < at + 8 + size:
                    break
                found.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
                at += 8 + size
            if len(found) == n:
                before, block = [s for s in starts if s[0] <= at][-1]
                return found, block, at - before
    raise ValueError(f"{path} has no complete BAM header")


def tags_end(data: bytes, at: int, end: int) -> bool:
    """Whether well-formed tags fill the bytes up to ``end``."""
    while at + 3 <= end:
        kind, at = chr(data[at + 2]), at + 3
        if kind in "ZH":
            at = data.find(b"\0", at, end) + 1
            if not at:
                return False
        elif kind == "B":
            if at + 5 > end or chr(data[at]) not in _SIZES:
                return False
            at += 5 + _SIZES[chr(data[at])] * struct.unpack_from("<I", data, at + 1)[0]
        elif kind in _SIZES:
            at += _SIZES[kind]
        else:
            return False
    return at == end


def plausible(data: bytes, at: int, n_refs: int) -> int:
    """The end of what looks like a record at ``at``; 0 if there is none, -1 if more data are needed to tell."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    need = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (l_name > 0 and l_seq >= 0 and need <= size and -1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1):
        return 0
    if at + 36 + l_name <= len(data):
        name = data[at + 36 : at + 35 + l_name]
        if data[at + 35 + l_name] != 0 or any(c < 33 or c > 126 for c in name):
            return 0
    if at + 4 + size > len(data):
        return -1 if size <= MOST_RECORD else 0
    return at + 4 + size if tags_end(data, at + 4 + need, at + 4 + size) else 0


def first_record(data: bytes, at: int, n_refs: int, ended: bool) -> tuple[int, bool]:
    """(place, True) of the first chain of records at or after ``at``; (place, False) if from there on more data are needed."""
    for guess in range(at, len(data)):
        end, chain = guess, 0
        while chain < CHAIN and end < len(data) and (found := plausible(data, end, n_refs)) > 0:
            end, chain = found, chain + 1
        if chain == CHAIN or ended and chain and end == len(data):
            return guess, True
        if not ended and (end >= len(data) or plausible(data, end, n_refs) < 0):
            return guess, False
    return len(data), ended


def parse(data: bytes, at: int, names: list[str], arrival: int) -> tuple:
    """The row of the record at ``at``, in the order of schema.ALIGNMENTS."""
    size, ref, pos, l_name, _, _, n_cigar, flag, l_seq, mate, mate_pos, insert = struct.unpack_from("<iiiBBHHHiiii", data, at)
    end, p = at + 4 + size, at + 36
    name = data[p : p + l_name - 1].decode()
    p += l_name
    cigar = [{"op": _OPS[c & 15], "len": c >> 4} for c in struct.unpack_from(f"<{n_cigar}I", data, p)]
    p += 4 * n_cigar + (l_seq + 1) // 2
    qual = bytes(min(q, 93) + 33 for q in data[p : p + l_seq]).decode()
    p += l_seq
    tags: dict[str, object] = {}
    while p + 3 <= end:
        tag, kind = data[p : p + 2].decode(), chr(data[p + 2])
        p += 3
        if kind in "ZH":
            stop = data.index(b"\0", p)
            tags[tag], p = data[p:stop].decode(), stop + 1
        elif kind == "B":
            p += 5 + _SIZES[chr(data[p])] * struct.unpack_from("<I", data, p + 1)[0]
        else:
            if kind in _INTS:
                tags[tag], = struct.unpack_from(_INTS[kind], data, p)
            p += _SIZES[kind]
    ref_of = lambda i: names[i] if i >= 0 else None
    on = lambda b: bool(flag & b)
    return (name, ref_of(ref), pos, ref_of(mate), mate_pos, insert, cigar, qual, on(1), on(512), not on(4), not on(256), not on(8), on(16), on(32), on(64), tags.get("NH"), tags.get("HI"), tags.get("MD"), arrival)


@dataclass
class Range(InputPartition):
    """Records that start between a block and the place ``until`` (block offset << 16 | place in the block); ``skip`` bytes of the first block don't count, -1 if unknown."""

    path: str
    names: list[str]
    start: int
    until: int
    skip: int


def records(part: Range) -> Iterator[tuple]:
    for data, at, arrival in walk(part):
        yield parse(data, at, part.names, arrival)


def walk(part: Range) -> Iterator[tuple[bytes, int, int]]:
    """(data, place in them, place in the file) of the records of a range."""
    with _open(part.path) as file:
        size = file.size()
        start = part.start if part.skip >= 0 else first_block(file, part.start, size)
        data, at, spans, synced, shown = b"", max(part.skip, 0), [], part.skip >= 0, 0
        for offset, content in itertools.chain(blocks(file, start, size), [(size, b"")]):
            if offset << 16 >= part.until and (not data[at:] or not synced and not spans):
                return
            if offset < size:
                spans.append((shown + len(data), offset))
            data += content
            if not synced:
                at, synced = first_record(data, at, len(part.names), offset >= size)
                if not synced:
                    continue
            while at + 4 <= len(data) and at + 4 + struct.unpack_from("<i", data, at)[0] <= len(data):
                place = shown + at
                while len(spans) > 1 and spans[1][0] <= place:
                    spans.pop(0)
                arrival = (spans[0][1] << 16) | (place - spans[0][0])
                if arrival >= part.until:
                    return
                yield data, at, arrival
                at += 4 + struct.unpack_from("<i", data, at)[0]
            shown, data, at = shown + at, data[at:], 0


def split(path: str, names: list[str], first: int, skip: int, end: int, size: int) -> list[Range]:
    """Ranges of about ``size`` bytes between two block offsets; the first one's records start at ``skip``, or anywhere (-1)."""
    cuts = [first, *range(first + size, end, size), end]
    return [Range(path, names, a, b << 16, -1 if i else skip) for i, (a, b) in enumerate(itertools.pairwise(cuts)) if a < b]


#: Levels of the bins of an index: how far a position is shifted, and the first bin of that size.
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0))
#: Chunks of a bin end where a stretch of so many bits of compressed bytes does, so an index has no more of them than it has such stretches and bins.
GRAIN_BITS = 20


def bins_of(low: int, high: int) -> set[int]:
    """The bins that may hold records over positions low to high, both 0-based and included."""
    return {b for shift, first in LEVELS for b in range(first + (low >> shift), first + (min(high, (1 << 29) - 1) >> shift) + 1)}


def read_index(content: bytes) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """For each reference the chunks of its bins and the first place of each window of 16 KB."""
    if content[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    n, = struct.unpack_from("<i", content, 4)
    at, out = 8, []
    for _ in range(n):
        held, (n_bins,), at = {}, struct.unpack_from("<i", content, at), at + 4
        for _ in range(n_bins):
            name, n_chunks = struct.unpack_from("<Ii", content, at)
            flat = struct.unpack_from(f"<{2 * n_chunks}Q", content, at + 8)
            held[name] = list(zip(flat[::2], flat[1::2], strict=True))
            at += 8 + 16 * n_chunks
        n_windows, = struct.unpack_from("<i", content, at)
        out.append((held, list(struct.unpack_from(f"<{n_windows}Q", content, at + 4))))
        at += 4 + 8 * n_windows
    return out


def chunks_of(found: tuple[dict[int, list[tuple[int, int]]], list[int]], low: int, high: int) -> list[tuple[int, int]]:
    """Places in the file between which the records over positions low to high lie; those that touch are one."""
    held, windows = found
    window = min(low >> 14, len(windows) - 1)
    least = windows[window] if window >= 0 else 0
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(a, least), b) for name in bins_of(low, high) for a, b in held.get(name, []) if b > least):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.refs: set[str] | None = None
        self.low, self.high = 0, (1 << 31) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Notes which references and positions are asked for; Spark still tests every row."""
        for f in filters:
            if f.attribute == ("ref",) and isinstance(f, EqualTo | In):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.refs = wanted if self.refs is None else self.refs & wanted
            elif f.attribute == ("pos",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if f.attribute == ("pos",) and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Range]:
        out = []
        for path in files_of(self.path):
            found, first, skip = header(path)
            names = [name for name, _ in found]
            fs, name = blobs.filesystem(path)
            if self.refs is not None and fs.get_file_info(f"{name}.bai").type == pafs.FileType.File:
                with fs.open_input_stream(f"{name}.bai") as held:
                    index = read_index(held.read())
                for ref in sorted(names.index(r) for r in self.refs if r in names):
                    for a, b in chunks_of(index[ref], self.low, self.high) if self.low <= self.high else []:
                        parts = split(path, names, a >> 16, a & 0xFFFF, max((b >> 16) + 1, (a >> 16) + 1), self.split)
                        parts[-1].until = b
                        out += parts
                continue
            with _open(path) as file:
                out += split(path, names, first, skip, file.size(), self.split)
        return out

    def read(self, partition: Range | None) -> Iterator[tuple]:
        return iter(()) if partition is None else records(partition)


class BamStreamReader(DataSourceStreamReader):
    """Offsets are {file: block offset up to which it is read}; each goes forward by at most ``maxBytesPerTrigger`` over all files, whole blocks."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split, self.most = options["path"], int(options.get("splitBytes", SPLIT_BYTES)), int(options.get("maxBytesPerTrigger", 0))
        self.progress, self.at = options.get("progress"), None
        if self.most and not self.progress:
            raise ValueError("maxBytesPerTrigger needs a folder progress")

    def initialOffset(self) -> dict:
        return {}

    def _held(self) -> dict:
        """The furthest offset that any run of this stream was given."""
        if self.at is None:
            self.at = {}
            if self.progress:
                fs, name = blobs.filesystem(f"{self.progress}/offset.json")
                if fs.get_file_info(name).type == pafs.FileType.File:
                    with fs.open_input_stream(name) as held:
                        self.at = json.loads(held.read())
        return self.at

    def latestOffset(self) -> dict:
        out, left = dict(self._held()), self.most
        for path in files_of(self.path):
            with _open(path) as file:
                size, at = file.size(), int(out.get(path, 0))
                end = size
                if self.most and size - at > left:
                    end = first_block(file, at + left, size) if left else at
                left = max(0, left - (end - at))
                if end > at:
                    out[path] = end
            if self.most and not left:
                break
        if self.progress and out != self.at:
            # Written before it is given out, so no later run starts from less than Spark may have noted.
            fs, folder = blobs.filesystem(self.progress)
            fs.create_dir(folder, recursive=True)
            new = f"{folder}/offset.{uuid.uuid4().hex}"
            with fs.open_output_stream(new) as held:
                held.write(json.dumps(out).encode())
            fs.move(new, f"{folder}/offset.json")
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in end.items():
            found, first, skip = header(path)
            at = int(start.get(path, 0))
            if int(stop) > max(at, first):
                out += split(path, [name for name, _ in found], max(at, first), -1 if at > first else skip, int(stop), self.split)
        return out

    def read(self, partition: Range | None) -> Iterator[tuple]:
        return iter(()) if partition is None else records(partition)


class BamSource(DataSource):
    """Alignments of a BAM file, with the columns of schema.ALIGNMENTS; arrival is the record's place in the file."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return schema.ALIGNMENTS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)

    def streamReader(self, schema) -> BamStreamReader:
        return BamStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)


def index_rows(part: Range) -> dict[tuple[int, int, int], tuple[int, int]]:
    """What an index needs of a range's records: first place and end by (reference, bin, stretch), and first place by (reference, -1 - window, 0)."""
    out: dict[tuple[int, int, int], list[int]] = {}
    head, covers = struct.Struct("<iiiBBHHH").unpack_from, frozenset(_OPS.index(c) for c in "MDN=X")
    levels = LEVELS[:-1]
    for data, at, place in walk(part):
        _, ref, low, l_name, _, _, n_cigar, _ = head(data, at)
        if ref < 0 or low < 0:
            continue
        ops = struct.unpack_from(f"<{n_cigar}I", data, at + 36 + l_name)
        high = low + max(1, sum(c >> 4 for c in ops if c & 15 in covers)) - 1
        name = next((first + (low >> shift) for shift, first in levels if low >> shift == high >> shift), 0)
        held = out.setdefault((ref, name, place >> 16 + GRAIN_BITS), [place, place + 1])
        held[1] = place + 1
        for window in range(low >> 14, (high >> 14) + 1):
            out.setdefault((ref, -1 - window, 0), [place, 0])
    return out


def index(spark: SparkSession, path: str) -> None:
    """Writes the index of every file of a path beside it, from one pass over the records of all.

    What meets in one task is a row for each bin and stretch of a file, and one for each window of 16 KB.
    """
    register(spark)
    files = files_of(path)
    ranges: list[tuple[int, int, int, int, int]] = []
    sizes: list[int] = []
    for no, file in enumerate(files):
        names, first, skip = header(file)
        sizes.append(len(names))
        with _open(file) as held:
            ranges += [(len(ranges) + k, no, r.start, r.until, r.skip) for k, r in enumerate(split(file, [], first, skip, held.size(), SPLIT_BYTES))]
        ranges.append((len(ranges), no, -1, 0, 0))  # so that a file without records has an index

    def scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for r in frame.to_pylist():
                found = index_rows(Range(files[r["no"]], [""] * sizes[r["no"]], r["start"], r["until"], r["skip"])) if r["start"] >= 0 else {(-1, 0, 0): (0, 0)}
                flat = [(r["no"], *key, *value) for key, value in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*flat, strict=True)] if flat else [pa.array([], pa.int64())] * 6, ["no", "ref", "bin", "part", "a", "b"])

    def put(rows: pd.DataFrame) -> pd.DataFrame:
        no = int(rows["no"].iloc[0])
        held: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for ref, name, a, b in rows[["ref", "bin", "a", "b"]].itertuples(index=False):
            held.setdefault(ref, {}).setdefault(name, []).append((a, b))
        fs, name = blobs.filesystem(f"{files[no]}.bai")
        with fs.open_output_stream(name) as target:
            target.write(index_content([held.get(ref, {}) for ref in range(sizes[no])]))
        return rows[["no"]].head(1)

    if ranges:
        dealt = spark.createDataFrame(ranges, "id long, no long, start long, until long, skip long").repartition(len(ranges), "id")
        found = dealt.mapInArrow(scan, "no long, ref long, bin long, part long, a long, b long")
        found.groupBy("no", "ref", "bin", "part").agg(F.min("a").alias("a"), F.max("b").alias("b")).groupBy("no").applyInPandas(put, "no long").count()


def index_content(references: list[dict[int, list[tuple[int, int]]]]) -> bytes:
    """The bytes of an index, from the chunks of each reference's bins and the first place of window w at -1 - w."""
    out = [b"BAI\1", struct.pack("<i", len(references))]
    for some in references:
        out.append(struct.pack("<i", sum(b >= 0 for b in some)))
        for b in sorted(b for b in some if b >= 0):
            out += [struct.pack("<Ii", b, len(some[b])), *(struct.pack("<QQ", *c) for c in sorted(some[b]))]
        starts = [some[-w - 1][0][0] if -w - 1 in some else 0 for w in range(max((-b for b in some if b < 0), default=0))]
        # A window without records takes the place of the one before it.
        starts = list(itertools.accumulate(starts, lambda before, now: now or before))
        out += [struct.pack("<i", len(starts)), struct.pack(f"<{len(starts)}Q", *starts)]
    return b"".join(out)


END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_FILE_BYTES = 64 << 20


def compressed(data: bytes) -> bytes:
    """BGZF blocks of the data."""
    out = []
    for at in range(0, len(data), 0xFF00):
        raw = data[at : at + 0xFF00]
        squeeze = zlib.compressobj(wbits=-15)
        body = squeeze.compress(raw) + squeeze.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw)))
    return b"".join(out)


def encode(row: dict, number: dict[str, int]) -> bytes:
    """The record of a row of schema.ALIGNMENTS. Bases, which the table doesn't hold, are N."""
    ops = row["cigar"] or []
    name, qual = row["name"].encode() + b"\0", (row["qual"] or "").encode()
    flags = ("is_paired", 1), ("is_rev", 16), ("mate_rev", 32), ("is_first", 64), ("is_qcfail", 512)
    flag = sum(bit for c, bit in flags if row[c]) | 4 * (not row["is_mapped"]) | 8 * (not row["mate_mapped"]) | 128 * bool(row["is_paired"] and not row["is_first"]) | 256 * (not row["is_primary"])
    low = row["pos"]
    high = low + max(1, sum(c["len"] for c in ops if c["op"] in "MDN=X")) - 1
    place = next((first + (low >> shift) for shift, first in LEVELS if low >> shift == high >> shift), 0) if low >= 0 else 4680
    tags = b"".join(tag + b"i" + struct.pack("<i", row[c]) for tag, c in ((b"NH", "nh"), (b"HI", "hi")) if row[c] is not None) + (b"MDZ" + row["md"].encode() + b"\0" if row["md"] is not None else b"")
    head = struct.pack("<iiBBHHHiiii", number.get(row["ref"], -1), low, len(name), 255, place, len(ops), flag, len(qual), number.get(row["mate_ref"], -1), row["mate_pos"], row["insert_size"] or 0)
    body = head + name + b"".join(struct.pack("<I", c["len"] << 4 | _OPS.index(c["op"])) for c in ops) + b"\xff" * ((len(qual) + 1) // 2) + bytes(c - 33 for c in qual) + tags
    return struct.pack("<i", len(body)) + body


_HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("quality", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("insert", "<i4")])
_CODES = np.full(256, 255, np.uint32)
_CODES[list(_OPS.encode())] = range(len(_OPS))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after another, and the length of each; null is empty."""
    held = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    data = np.frombuffer(held.buffers()[2], np.uint8) if held.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], np.diff(bounds)


def encode_all(batch: pa.RecordBatch, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that encode() makes of each row of schema.ALIGNMENTS, one after another, and where each ends."""
    column, many = lambda c: batch.column(batch.schema.get_field_index(c)), batch.num_rows
    for c in ("name", "pos", "mate_pos"):
        if column(c).null_count:
            raise ValueError(f"a record has no {c}")
    whole = lambda c: column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    on = lambda c: column(c).fill_null(False).to_numpy(zero_copy_only=False)
    there = lambda c: column(c).is_valid().to_numpy(zero_copy_only=False)

    def reference(c: str) -> np.ndarray:
        held = column(c).dictionary_encode()
        at = np.array([number.get(x, -1) for x in held.dictionary.to_pylist()] + [-1])
        return at[held.indices.fill_null(len(at) - 1).to_numpy(zero_copy_only=False)]

    (names, n_name), (quals, n_qual), (mds, n_md) = (_bytes_of(column(c)) for c in ("name", "qual", "md"))
    cigars = column("cigar")
    n_ops = pc.list_value_length(cigars).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ops = cigars.flatten()
    letters, widths = _bytes_of(ops.field("op"))
    codes = _CODES[letters] if (widths == 1).all() else np.full(1, 255)
    if (codes == 255).any():
        raise ValueError("a CIGAR has an unknown operation")
    lengths = ops.field("len").to_numpy(zero_copy_only=False).astype(np.int64)
    if (n_name > 254).any() or (n_ops > 65535).any():
        raise ValueError("a record's name or CIGAR is too long for BAM")
    covered = np.concatenate([[0], np.cumsum(np.where(np.isin(codes, [_OPS.index(c) for c in "MDN=X"]), lengths, 0))])
    bounds = np.concatenate([[0], np.cumsum(n_ops)])
    low = whole("pos")
    high = low + np.maximum(1, covered[bounds[1:]] - covered[bounds[:-1]]) - 1
    place = np.zeros(many, np.int64)
    for shift, first in reversed(LEVELS):
        place = np.where(low >> shift == high >> shift, first + (low >> shift), place)

    paired, first_of = on("is_paired"), on("is_first")
    flag = sum(bit * on(c).astype(np.int64) for c, bit in (("is_paired", 1), ("is_rev", 16), ("mate_rev", 32), ("is_first", 64), ("is_qcfail", 512)))
    flag = flag + 4 * ~on("is_mapped") + 8 * ~on("mate_mapped") + 128 * (paired & ~first_of) + 256 * ~on("is_primary")
    has_nh, has_hi, has_md = there("nh"), there("hi"), there("md")
    n_bases = (n_qual + 1) // 2
    parts = [np.full(many, 36), n_name + 1, 4 * n_ops, n_bases, n_qual, 7 * has_nh, 7 * has_hi, (n_md + 4) * has_md]
    ends = np.cumsum(sum(parts))
    starts = np.cumsum(np.stack([ends - sum(parts), *parts[:-1]]), axis=0)
    head = np.zeros(many, _HEAD)
    for c, value in (("size", sum(parts) - 4), ("ref", reference("ref")), ("pos", low), ("l_name", n_name + 1), ("quality", 255), ("bin", np.where(low >= 0, place, 4680) & 0xFFFF), ("n_cigar", n_ops), ("flag", flag), ("l_seq", n_qual), ("mate", reference("mate_ref")), ("mate_pos", whole("mate_pos")), ("insert", whole("insert_size"))):
        head[c] = value
    out = np.full(int(ends[-1]) if many else 0, 255, np.uint8)

    def put(at: np.ndarray, size: np.ndarray, data: np.ndarray) -> None:
        """Pieces of data, one after another, to these places."""
        out[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(data))] = data

    def put_tag(at: np.ndarray, some: np.ndarray, name: bytes, value: np.ndarray) -> None:
        raw = np.concatenate([np.tile(np.frombuffer(name + b"i", np.uint8), (int(some.sum()), 1)), value[some].astype("<i4").view(np.uint8).reshape(-1, 4)], axis=1)
        out[at[some][:, None] + np.arange(7)] = raw

    out[starts[0][:, None] + np.arange(36)] = head.view(np.uint8).reshape(many, 36)
    put(starts[1], n_name, names)
    out[starts[1] + n_name] = 0
    put(starts[2], 4 * n_ops, (lengths << 4 | codes).astype("<u4").view(np.uint8))
    put(starts[4], n_qual, quals - 33)
    put_tag(starts[5], has_nh, b"NH", whole("nh"))
    put_tag(starts[6], has_hi, b"HI", whole("hi"))
    out[starts[7][has_md][:, None] + np.arange(3)] = np.frombuffer(b"MDZ", np.uint8)
    put(starts[7] + 3, n_md, mds)
    out[(starts[7] + 3 + n_md)[has_md]] = 0
    return out, ends


def write(alignments: DataFrame, path: str, references: list[tuple[str, int]], file_bytes: int = _FILE_BYTES) -> None:
    """Writes alignments in the order of the references and positions, as BAM files that are each complete and of at most about ``file_bytes`` before compression.

    Files come from attempts that were committed only; one after another in the order of
    their names they are the whole. References are those of the header.
    """
    number = {name: i for i, (name, _) in enumerate(references)}
    text = b"@HD\tVN:1.6\tSO:coordinate\n" + b"".join(f"@SQ\tSN:{n}\tLN:{size}\n".encode() for n, size in references)
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references)) + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in references)
    table = alignments.sparkSession.createDataFrame([(n, i) for n, i in number.items()], "__name string, __no int")
    known = alignments.join(F.broadcast(table), alignments["ref"] == table["__name"], "left")
    order = [F.col("__no").asc_nulls_last(), F.col("pos").asc(), F.col("arrival").asc()]
    columns = alignments.columns

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        part, no, held, size = TaskContext.get().partitionId(), 0, [], 0

        def file() -> tuple[str, bytes]:
            return f"{part:07d}-{no:07d}.bam", compressed(head) + compressed(b"".join(held)) + END_BLOCK

        for batch in batches:
            data, ends = encode_all(batch, number)
            begin = 0
            while begin < len(data):
                # A file ends with the record that fills it.
                last = int(np.searchsorted(ends, begin + file_bytes - size))
                end = int(ends[min(last, len(ends) - 1)])
                held.append(data[begin:end].tobytes())
                size, begin = size + end - begin, end
                if size >= file_bytes:
                    yield file()
                    no, held, size = no + 1, [], 0
        if held:
            yield file()

    blobs.write_made(known.repartitionByRange(*order).sortWithinPartitions(*order).select(columns), parts, path)
