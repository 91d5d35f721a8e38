"""Suffix-array dedup: exact removal of repeated byte strings by a distributed merge sort.

A byte goes if a string of MATCH bytes that covers it also starts in a document with a
smaller doc_id. Suffixes are sorted where they can matter: at anchors, the places with
the least hash of GRAM bytes among the starts inside a MATCH-byte window, so that equal
windows have the same anchor. Anchors whose gram occurs in one document only, and with
them the windows that they own, drop out first, by an exchange of hashes.

For the rest each task sorts the suffixes at its anchors (as far as a window can reach) and resolves what
its own documents repeat. What stays open goes out as a front-coded run: the length of the prefix in
common with the suffix before, and the bytes after it, dealt by ranges of the sorted
order. The receiving task combines its runs with a loser tree over common-prefix
lengths: of two heads the one that shares more with the last output is smaller, and
only heads that share equally much are compared, from there on, so no known prefix
is compared again. The merged order with its common-prefix lengths tells for each
length which suffixes agree; those whose bytes before the anchor agree too hold equal windows.

No pairs are formed: each group of equal windows is reduced to its smallest doc_id. Copies of whole
texts are settled before by a digest. Suffixes of a gram that fills more than a range go to several by
what its windows have on one side of it, so a gram that very many documents hold in
different surroundings is not one task's work.

Nulls and ties: null text is empty; a null doc_id comes before all others and shows as
null. Rows that share a doc_id don't remove each other's bytes. Texts shorter than
MATCH lose nothing. Empty tables are fine; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm._shared import join_counted, written
from helixloom.llm._text import _SPREAD, _powers, chunks, mix64

MATCH = 50
GRAM = 16
REACH = MATCH - GRAM
#: Windows that start farther before their anchor than this are told by what is before it.
NEAR = 17
#: Rows from which the borders of the sorted ranges are taken, on average, and grams of a row at most: they only even out ranges, no result depends on them.
SAMPLE_ROWS = 2000
SAMPLE_GRAMS = 1024
_KEY = "coalesce(cast(doc_id as bigint), -9223372036854775808)"
#: Anchors and suffixes of one sorted run; a task starts another run when it holds so many.
RUN_ANCHORS = 1 << 19
RUN_SUFFIXES = 1 << 17
#: Bytes of text for which a task holds hashes and masks at one time; a longer text is a chunk of its own.
_CHUNK = 1 << 19


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """least() over every ``width`` successive values."""
    out, span = values, 1
    while span * 2 <= width:
        out = least(out[:-span], out[span:])
        span *= 2
    return out if span == width else least(out[: len(out) - (width - span)], out[width - span :])


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and the hashes of their grams."""
    n = len(raw)
    if n < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SPREAD[raw] * up[:n], out=sums[1:])
    key = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # A window is inside a document if no document starts in its bytes after the first.
    starts = np.zeros(n + 1, np.int32)
    np.add.at(starts, offsets[1:-1][offsets[1:-1] <= n], 1)
    before = np.cumsum(starts)
    whole = before[MATCH - 1 : n] == before[: n - MATCH + 1]
    least = np.where(whole, _sliding(key, REACH + 1, np.minimum), np.uint64(0))
    edge = np.zeros(REACH, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum)
    at = np.flatnonzero((key <= most) & (most > 0))
    return at, key[at]


def owners(at: np.ndarray, key: np.ndarray, again: np.ndarray, raw_size: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recurring anchors (as indexes) that own windows, and how far before the anchor those start, least and most."""
    none = np.zeros(0, np.int64)
    if raw_size < MATCH or not again.any():
        return none, none, none
    mark = np.zeros(raw_size + 1, np.int64)
    mark[at + 1] = 1
    until = np.cumsum(mark)
    recur = np.concatenate([[0], np.cumsum(again)])
    i = np.arange(raw_size - MATCH + 1)
    first, end = until[i], until[i + REACH + 1]
    starts = np.zeros(raw_size + 1, np.int32)
    np.add.at(starts, offsets[1:-1], 1)
    before = np.cumsum(starts)
    good = (before[MATCH - 1 : raw_size] == before[: raw_size - MATCH + 1]) & (recur[end] > recur[first])
    i, first, end = i[good], first[good], end[good]
    best, step = first.copy(), first + 1
    live = np.flatnonzero(step < end)
    while len(live):
        s = step[live]
        better = key[s] < key[best[live]]
        best[live[better]] = s[better]
        step[live] += 1
        live = live[step[live] < end[live]]
    mine = again[best]
    i, best = i[mine], best[mine]
    if not len(i):
        return none, none, none
    head = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    tail = np.append(head[1:], len(best)) - 1
    own = best[head]
    return own, at[own] - i[tail], at[own] - i[head]


def resolve(common: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For suffixes in sorted order: bit o says that the window starting o bytes before the anchor is in a smaller doc.

    common: bytes shared with the suffix before; left: the bytes before the anchor, nearest first.
    """
    n = len(doc)
    out = np.zeros(n, np.uint64)
    behind = np.zeros(n, np.uint64)
    for o in range(REACH + 1):
        if o:
            behind = mix64(behind + left[:, o - 1] + np.uint64(1))
        live = np.flatnonzero((low <= o) & (o <= high))
        if len(live) < 2:
            continue
        group = np.cumsum(common < MATCH - o)[live]
        size = np.bincount(group)
        live = live[size[group] > 1]
        if not len(live):
            continue
        same = mix64(behind[live] + np.cumsum(common < MATCH - o)[live].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(same, kind="stable")
        ranked, mine = same[order], doc[live[order]]
        head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        least = np.repeat(np.minimum.reduceat(mine, head), np.diff(np.append(head, len(mine))))
        hit = live[order[mine > least]]
        out[hit] |= np.uint64(1 << o)
    return out


def spans(place: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the windows in ``bits``: which element, start, and length."""
    which, start, size = [], [], []
    left = np.flatnonzero(bits)
    rest = bits[left]
    while len(left):
        lowest = rest & (~rest + np.uint64(1))
        o = np.log2(lowest.astype(np.float64)).astype(np.int64)
        run = (rest >> o.astype(np.uint64)) + np.uint64(1)
        many = np.log2((run & (~run + np.uint64(1))).astype(np.float64)).astype(np.int64)
        which.append(left)
        start.append(place[left] - (o + many - 1))
        size.append(many - 1 + MATCH)
        rest = rest & ~(((np.uint64(1) << many.astype(np.uint64)) - np.uint64(1)) << o.astype(np.uint64))
        keep = rest > 0
        left, rest = left[keep], rest[keep]
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(which), np.concatenate(start), np.concatenate(size)


def merge(runs: list[tuple[np.ndarray, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Merges front-coded sorted runs: order (places in the runs' concatenation) and common-prefix lengths.

    A run is the lengths of the prefixes in common with the suffix before, and the bytes
    after those prefixes, one suffix of MATCH bytes after the other.
    """
    base = np.concatenate([[0], np.cumsum([len(c) for c, _ in runs])]).tolist()
    if len(runs) == 1:
        common = runs[0][0].astype(np.int64)
        return np.arange(len(common)), common
    commons = [c.tolist() for c, _ in runs]
    k = 1 << max(0, (len(runs) - 1).bit_length())
    tails, ends = [b for _, b in runs], [0] * k
    lcp, begin, tail = [-1] * k, [0] * k, [b""] * k  # of each head: shared with the last output; where its tail begins; tail
    at = [0] * k

    def load(r: int) -> None:
        c = commons[r][at[r]]
        size = MATCH - c
        tail[r] = tails[r][ends[r] : ends[r] + size]
        ends[r] += size
        lcp[r] = begin[r] = c

    for r in range(len(runs)):
        if commons[r]:
            load(r)

    def wins(a: int, b: int) -> bool:
        """Whether head a goes before head b; the loser's shared length becomes that with the winner."""
        x, y = lcp[a], lcp[b]
        if x != y:
            return x > y
        if x < 0:
            return True
        s, t = tail[a][x - begin[a] :], tail[b][x - begin[b] :]
        if s == t:
            lcp[b] = MATCH
            return True
        n = 0
        while s[n] == t[n]:
            n += 1
        if s[n] < t[n]:
            lcp[b] = x + n
            return True
        lcp[a] = x + n
        return False

    loser = [0] * k
    winner = list(range(k))
    level = winner
    size = k
    while size > 1:
        above = []
        for j in range(0, size, 2):
            a, b = level[j], level[j + 1]
            first = wins(a, b)
            loser[(size + j) >> 1] = b if first else a
            above.append(a if first else b)
        level, size = above, size >> 1
    top = level[0]
    order, common = [], []
    push, note = order.append, common.append
    while lcp[top] >= 0:
        push(base[top] + at[top])
        note(lcp[top])
        at[top] += 1
        if at[top] < len(commons[top]):
            load(top)
        else:
            lcp[top] = -1
        node = (k + top) >> 1
        while node:
            other = loser[node]
            x, y = lcp[top], lcp[other]
            if y > x or x == y and x >= 0 and not wins(top, other):
                loser[node], top = top, other
            node >>= 1
    return np.array(order, np.int64), np.array(common, np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Compressed, byte planes apart."""
    if not values.size:
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: str, width: int = 1) -> np.ndarray:
    if not n:
        return np.zeros((0, width) if width > 1 else 0, kind)
    size = n * width * np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8)
    flat = np.ascontiguousarray(planes.reshape(-1, n).T)
    return flat.view(kind).reshape(n, width) if width > 1 else flat.view(kind).ravel()


class _Held:
    """Arrays gathered over the batches of a task."""

    def __init__(self, n: int) -> None:
        self.parts: list[list[np.ndarray]] = [[] for _ in range(n)]

    def add(self, *arrays: np.ndarray) -> None:
        for part, array in zip(self.parts, arrays, strict=True):
            part.append(array)

    def all(self) -> list[np.ndarray]:
        return [np.concatenate(p) for p in self.parts] if self.parts[0] else []


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("key").to_numpy(), batch.column("version").to_numpy()


def gram_runs(texts: DataFrame, parts: int) -> DataFrame:
    """Sorted runs of anchor hashes with the documents they come from, dealt by ranges of the hash.

    Anchors whose gram a task itself sees in several documents are settled: they are dealt
    evenly, and only those of the least and the largest document go to the range of the hash.
    """

    def flush(held: _Held, docs: _Held) -> Iterator[pa.RecordBatch]:
        key, row, number = held.all()
        ids, versions = docs.all()
        order = np.lexsort((ids[row], key))
        key, row, number = key[order], row[order], number[order]

        def record(part: int, settled: int, used: np.ndarray, mine: np.ndarray, step: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
            values = (step, mine.astype(np.uint32), number, np.diff(ids[used], prepend=0), versions[used])
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (part, settled, len(mine), len(used))] + [pa.array([_pack(x)], pa.binary()) for x in values], ["part", "settled", "n", "docs", "hashes", "rows", "numbers", "ids", "versions"])

        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tail = np.append(head[1:], len(key)) - 1
        several = np.repeat(ids[row[head]] != ids[row[tail]], tail - head + 1)
        if several.any():
            done, mine = np.unique(row[several], return_inverse=True)
            yield record(int(mix64(ids[:1].view(np.uint64))[0] % np.uint64(parts)), 1, done, mine, key[:0], number[several])
        send = ~several
        send[head] = send[tail] = True
        key, row, number = key[send], row[send], number[send]
        bounds = np.searchsorted(key, np.array([(p << 40) // parts for p in range(parts + 1)], np.uint64))
        for p in range(parts):
            a, b = bounds[p], bounds[p + 1]
            if a < b:
                used, mine = np.unique(row[a:b], return_inverse=True)
                yield record(p, 0, used, mine, np.diff(key[a:b], prepend=np.uint64(0)), number[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, rows, full = _Held(3), _Held(2), 0, 0
        for batch in batches:
            for part, raw, offsets in chunks(batch, most=_CHUNK):
                at, key = anchors(raw, offsets)
                row = np.searchsorted(offsets, at, side="right") - 1
                first = np.searchsorted(at, offsets)
                # Anchors have the least hashes of their windows; mixed again, they are spread evenly.
                held.add(mix64(key + np.uint64(1)) >> np.uint64(24), (row + rows).astype(np.uint32), (np.arange(len(at)) - first[row]).astype(np.uint32))
                docs.add(*_ids(part))
                rows, full = rows + part.num_rows, full + len(at)
                if full >= RUN_ANCHORS:
                    yield from flush(held, docs)
                    held, docs, rows, full = _Held(3), _Held(2), 0, 0
        if full:
            yield from flush(held, docs)

    return texts.mapInArrow(run, "part long, settled long, n long, docs long, hashes binary, rows binary, numbers binary, ids binary, versions binary")


def recurring(runs: DataFrame) -> DataFrame:
    """key, version and number of the anchors whose gram is in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(4)
        for batch in batches:
            for r in batch.to_pylist():
                row = _unpack(r["rows"], r["n"], "u4")
                ids, versions = np.cumsum(_unpack(r["ids"], r["docs"], "i8")), _unpack(r["versions"], r["docs"], "i8")
                number = _unpack(r["numbers"], r["n"], "u4")
                if r["settled"]:
                    for a in range(0, len(row), 1 << 17):
                        of = row[a : a + (1 << 17)]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(versions[of]), pa.array(number[a : a + (1 << 17)].astype(np.int32))], ["key", "version", "number"])
                else:
                    held.add(np.cumsum(_unpack(r["hashes"], r["n"], "u8")), ids[row], versions[row], number)
        got = held.all()
        if got:
            order = np.argsort(got[0], kind="stable")
            key, ids, versions, number = (x[order] for x in got)
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(head, len(key)))
            several = np.repeat(np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head), size)
            pick = np.flatnonzero(several)
            for a in range(0, len(pick), 1 << 17):
                p = pick[a : a + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(versions[p]), pa.array(number[p].astype(np.int32))], ["key", "version", "number"])

    return runs.mapInArrow(run, "key long, version long, number int")


def _suffixes(raw: np.ndarray, offsets: np.ndarray, place: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MATCH bytes from each place on, and the ``high`` bytes before it, nearest first; zeros beyond the text."""
    row = np.searchsorted(offsets, place, side="right") - 1
    on = place[:, None] + np.arange(MATCH)
    right = np.where(on < offsets[row + 1][:, None], raw[np.minimum(on, len(raw) - 1)], 0).astype(np.uint8)
    steps = np.arange(1, REACH + 1)
    left = np.where(steps <= high[:, None], raw[np.maximum(place[:, None] - steps, 0)], 0).astype(np.uint8)
    return right, left


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    weights = mix64(np.arange(1, rows.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return mix64((rows.astype(np.uint64) + np.uint64(1)) @ weights)


def split_hot(right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, hot: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes (as indexes, in their order) with low, high and part, where those of hot grams are dealt over all parts.

    A window that starts at most NEAR bytes before its anchor has the MATCH - NEAR bytes from
    there on, any other has NEAR + 1 bytes before it: so a hot suffix goes by the hash of the
    one for its near windows, and by that of the other, with the gram, for its far ones.
    """
    if not hot.any():
        return np.arange(len(part)), low, high, part
    near, far = np.flatnonzero(hot & (low <= NEAR)), np.flatnonzero(hot & (high > NEAR))
    rest = np.flatnonzero(~hot)
    to_near = (_row_hashes(right[near, : MATCH - NEAR]) % np.uint64(parts)).astype(np.int64)
    to_far = (_row_hashes(np.concatenate([left[far, : NEAR + 1], right[far, :GRAM]], axis=1)) % np.uint64(parts)).astype(np.int64)
    at = np.concatenate([rest, near, far])
    order = np.argsort(at, kind="stable")
    cat = lambda *x: np.concatenate(x)[order]
    return at[order], cat(low[rest], low[near], np.maximum(low[far], NEAR + 1)), cat(high[rest], np.minimum(high[near], NEAR), high[far]), cat(part[rest], to_near, to_far)


def suffix_runs(found: DataFrame, borders: np.ndarray, hot: np.ndarray) -> DataFrame:
    """Front-coded sorted runs of the suffixes that the task can't settle, and the spans it can, by range; suffixes of ``hot`` grams are dealt over all ranges."""

    def flush(held: _Held) -> Iterator[pa.RecordBatch]:
        got = held.all()
        order = np.argsort(got[0].view(f"S{MATCH}").ravel(), kind="stable")
        right, left, low, high, ids, versions, place = (x[order] for x in got)
        equal = right[1:] == right[:-1]
        common = np.concatenate([[0], np.where(equal.all(axis=1), MATCH, equal.argmin(axis=1))])
        bits = resolve(common, left, low, high, ids)
        whole = ((np.uint64(1) << (high - low + 1).astype(np.uint64)) - np.uint64(1)) << low.astype(np.uint64)
        open_bits = whole & ~bits
        which, start, size = spans(place, bits)
        dealt = np.searchsorted(borders, right[:, :GRAM].copy().view(f"S{GRAM}").ravel(), side="right")
        keep = np.flatnonzero(open_bits)
        opened = open_bits[keep]
        low = np.log2((opened & (~opened + np.uint64(1))).astype(np.float64)).astype(np.uint8)
        high = np.floor(np.log2(opened.astype(np.float64))).astype(np.uint8)
        right, left = right[keep], left[keep]
        grams = right[:, :GRAM].copy().view(f"S{GRAM}").ravel()
        at, low, high, part_of = split_hot(right, left, low, high, dealt[keep], np.isin(grams, hot), len(borders) + 1)
        right, left, keep = right[at], left[at], keep[at]
        left[np.arange(REACH) >= high[:, None]] = 0
        for p in np.unique(np.concatenate([part_of, dealt[which]])):
            mine = np.flatnonzero(part_of == p)
            done = np.flatnonzero(dealt[which] == p)
            own = right[mine]
            same = own[1:] == own[:-1]
            shared = np.concatenate([[0], np.where(same.all(axis=1), MATCH, same.argmin(axis=1))])[: len(mine)].astype(np.uint8)
            tails = own[np.arange(MATCH) >= shared[:, None]]
            e = keep[mine]
            docs = np.stack([np.concatenate([ids[e], ids[which[done]]]), np.concatenate([versions[e], versions[which[done]]])], axis=1)
            table, row = np.unique(docs, axis=0, return_inverse=True)
            spot = np.concatenate([place[e], start[done]]).astype(np.uint32)
            values = [shared, tails, left[mine], low[mine], high[mine], row.ravel().astype(np.uint32), spot, size[done].astype(np.uint8), np.diff(table[:, 0], prepend=0), table[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in (p, len(mine), len(done), len(tails), len(table))] + [pa.array([_pack(v)], pa.binary()) for v in values], _RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = _Held(7), 0
        for batch in batches:
            for part, raw, offsets in chunks(batch, most=_CHUNK):
                at, key = anchors(raw, offsets)
                first = np.searchsorted(at, offsets)
                lists = part.column("numbers")
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                again = np.zeros(len(at), bool)
                again[first[row] + lists.flatten().to_numpy(zero_copy_only=False)] = True
                own, low, high = owners(at, key, again, len(raw), offsets)
                if not len(own):
                    continue
                place = at[own]
                doc = np.searchsorted(offsets, place, side="right") - 1
                ids, versions = _ids(part)
                right, left = _suffixes(raw, offsets, place, high)
                held.add(right, left, low, high, ids[doc], versions[doc], place - offsets[doc])
                full += len(own)
                if full >= RUN_SUFFIXES:
                    yield from flush(held)
                    held, full = _Held(7), 0
        if full:
            yield from flush(held)

    _RUN = ["part", "n", "done", "bytes", "docs", "common", "tails", "left", "low", "high", "rows", "places", "sizes", "ids", "versions"]
    return found.mapInArrow(run, ", ".join(f"{c} {'long' if i < 5 else 'binary'}" for i, c in enumerate(_RUN)))


def covered(runs: DataFrame) -> DataFrame:
    """key, version and span (start * 256 + length) of bytes that windows of smaller documents cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                by_part.setdefault(r["part"], []).append(r)
        for part in sorted(by_part):
            held, fronts = _Held(6), []
            for r in by_part.pop(part):
                n, done = r["n"], r["done"]
                row, spot = _unpack(r["rows"], n + done, "u4"), _unpack(r["places"], n + done, "u4").astype(np.int64)
                ids, versions = np.cumsum(_unpack(r["ids"], r["docs"], "i8")), _unpack(r["versions"], r["docs"], "i8")
                if done:
                    at = row[n:]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(versions[at]), pa.array(spot[n:] * 256 + _unpack(r["sizes"], done, "u1"))], ["key", "version", "span"])
                if n:
                    fronts.append((_unpack(r["common"], n, "u1"), _unpack(r["tails"], r["bytes"], "u1").tobytes()))
                    held.add(_unpack(r["left"], n, "u1", REACH), _unpack(r["low"], n, "u1"), _unpack(r["high"], n, "u1"), ids[row[:n]], versions[row[:n]], spot[:n])
            if not fronts:
                continue
            order, common = merge(fronts)
            left, low, high, ids, versions, place = (x[order] for x in held.all())
            which, start, size = spans(place, resolve(common, left, low, high, ids))
            for a in range(0, len(which), 1 << 17):
                w = which[a : a + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[w]), pa.array(versions[w]), pa.array(start[a : a + (1 << 17)] * 256 + size[a : a + (1 << 17)])], ["key", "version", "span"])

    return runs.mapInArrow(run, "key long, version long, span long")


def borders(docs: DataFrame, parts: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams that cut the sorted order into ranges of about equal numbers of anchors, and those that fill a range of their own."""
    n = docs.count()
    if not n or parts < 2:
        return np.zeros(0, f"S{GRAM}"), np.zeros(0, f"S{GRAM}")
    # By place in the input, as many rows may have one doc_id, or none, and one text.
    sample = docs.withColumn("place", F.monotonically_increasing_id()).filter(F.pmod(F.xxhash64("place"), F.lit(1 << 40)) < int(min(1.0, sample_rows / n) * (1 << 40)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, offsets in chunks(batch, most=_CHUNK):
                at = anchors(raw, offsets)[0]
                bounds = np.searchsorted(at, offsets)
                size = np.diff(bounds)
                nth = np.arange(len(at)) - np.repeat(bounds[:-1], size)
                at = at[nth % np.repeat(np.maximum(5, -(-size // SAMPLE_GRAMS)), size) == 0]
                gram = raw[at[:, None] + np.arange(GRAM)]
                yield pa.RecordBatch.from_arrays([pa.array([g.tobytes() for g in gram], pa.binary())], ["gram"])

    grams = np.sort(np.array(sample.select("text").mapInArrow(run, "gram binary").toArrow().column("gram").to_pylist(), f"S{GRAM}"))
    if not len(grams):
        return grams, grams
    cuts, times = np.unique(grams[(np.arange(1, parts) * len(grams)) // parts], return_counts=True)
    return cuts, cuts[times > 1]


def dedup_bytes(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    spark = docs.sparkSession
    # A task holds the texts of its partition as one Arrow batch, so partitions are half as large as the session's.
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    twice = bool(picked.groupBy("doc_id").count().filter("count > 1").head(1))
    version = F.xxhash64("text") if twice else F.lit(0).cast("long")
    on = ["key", "version"] if twice else ["key"]
    texts = picked.select(F.expr(_KEY).alias("key"), version.alias("version"), "text").repartition(parts, *on)

    digests = picked.filter(F.octet_length("text") >= MATCH).select(F.expr(_KEY).alias("key"), version.alias("version"), F.md5(F.encode("text", "UTF-8")).alias("digest"))
    digests = written(digests, "suffix-digests")
    firsts = written(digests.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-firsts")
    copies = join_counted(digests, firsts, ["digest"], "n").filter("key != first").select("key", "version").distinct().repartition(parts, *on)

    # The three joins below read one exchange of the texts: it is dealt by just their keys, as
    # the other sides are, and no filter is pushed under it.
    cuts, hot = borders(picked, parts, sample_rows)
    marked = texts.join(copies.select(*on, F.lit(True).alias("copy")).hint("shuffle_hash"), on, "left")
    again = recurring(gram_runs(marked.filter("copy IS NULL").select("key", texts["version"], "text"), parts).repartitionById(parts, F.col("part").cast("int")))
    numbers = again.repartition(parts, *on).groupBy(*on).agg(F.collect_list("number").alias("numbers"))
    found = texts.join(numbers.hint("shuffle_hash"), on)
    spans_of = covered(suffix_runs(found, cuts, hot).repartitionById(len(cuts) + 1, F.col("part").cast("int")))
    spans_of = spans_of.unionByName(copies.withColumn("span", F.lit(-1).cast("long")))
    lists = spans_of.repartition(parts, *on).groupBy(*on).agg(F.collect_list("span").alias("spans"))
    done = texts.join(lists.hint("shuffle_hash"), on, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in chunks(batch, most=_CHUNK):
                rows = []
                lists = part.column("spans")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(size)])
                for i in range(part.num_rows):
                    own, cut = raw[offsets[i] : offsets[i + 1]], flat[at[i] : at[i + 1]]
                    if len(cut) and (cut < 0).any():
                        rows.append((len(own), len(own), 1, hashlib.sha256(b"").hexdigest(), b""))
                        continue
                    change = np.zeros(len(own) + 1, np.int64)
                    np.add.at(change, cut >> 8, 1)
                    np.add.at(change, (cut >> 8) + (cut & 255), -1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = own[~gone].tobytes()
                    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                    rows.append((len(own), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                key = part.column("key")
                shown = pa.array(key.to_numpy(), pa.int64(), mask=key.to_numpy() == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([shown, *[pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return done.select("key", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
