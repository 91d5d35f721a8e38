"""Repair of conversations whose turns are damaged.

Rows are taken by turn (null first; rows of one turn by role and text). A row's first fault counts: blank (nothing but
white space), duplicate (role and text of an earlier row), truncated (its last character
that isn't white space is none of ``.!?``). Edits: K keeps a row (cost 0), R makes its role the one that is due
(2), D deletes it (3; all that can be done with a blank row or a duplicate), I puts a row
without text before or behind one (2); a truncated row that stays adds 1. What is left has
the role initials ``(s?(ua)+)?``; of the cheapest edits those whose initials come first are taken.

Rows are sorted by ranges of (conversation, turn, ...), so a conversation that holds much of all
rows lies in several tasks. It is searched in blocks of BLOCK_ROWS: what a block does
to a conversation is the cheapest edits from each state in which it can begin to each in which it can
end, and those of successive blocks add up. Inside a block the search is a depth-first branch and
bound on an explicit stack. A suffix's bound is what it would cost if only costs counted,
so no prefix is followed that can't reach the least cost; the incumbent is the best
(cost, audit) so far; and for each node (row, state) a table has the best prefix that reached
it, and worse ones end there. The least audit is thereby proved.

A null text or role is one space here, so a null text is blank; a null conv_id is a conversation, and null turns don't
count for gaps. Equal rows are duplicates and their order doesn't matter. An empty
table gives no rows; other columns are ignored. The digest of a conversation's text is
sequential: its rows pass through one task in turn, in bounded memory, with its audit beside them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.llm._shared import written

BLOCK_ROWS = 256
SPACE = " \t\n\x0b\x0c\r"
#: States by the last role initial that stays: none yet, s, u, a.
START, S, U, A = range(4)
#: The state behind an initial that is kept, and the one behind a user or assistant row that is put in.
KEEP = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
DUE = (U, U, A, U)
#: Where a conversation may end.
ENDS = (START, A)
CLEAN, TRUNCATED, GONE = range(3)
_NEVER = 1 << 60


def bounds(rows: list[tuple[str, int]], ends: tuple[int, ...]) -> list[list[int]]:
    """For every row and state the least cost of what follows, so as to end in one of ``ends``; audits don't count."""
    last = [0 if s in ends else _NEVER for s in range(4)]

    def inserted(cost: list[int]) -> list[int]:
        for _ in range(2):
            cost = [min(cost[s], 2 + cost[DUE[s]]) for s in range(4)]
        return cost

    out = [inserted(last)]
    for initial, fault in reversed(rows):
        after, here = out[-1], []
        for s in range(4):
            options = [3 + after[s]]
            if fault != GONE:
                options += [2 + fault + after[DUE[s]], fault + after[KEEP[s][initial]] if initial in KEEP[s] else _NEVER]
            here.append(min(options))
        out.append(inserted(here))
    return out[::-1]


def cheapest(rows: list[tuple[str, int]], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the best edits of rows (initial, fault) from a state to one of ``ends``; None if there are none."""
    least = bounds(rows, ends)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        floor = cost + least[i][state]
        if floor >= _NEVER or best is not None and floor > best[0]:
            continue
        if (i, state) in reached and reached[i, state] <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == len(rows) and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        most = floor if best is None else best[0]
        moves = [(i, DUE[state], cost + 2, audit + "I")]
        if i < len(rows):
            initial, fault = rows[i]
            moves.append((i + 1, state, cost + 3, audit + "D"))
            if fault != GONE:
                moves.append((i + 1, DUE[state], cost + 2 + fault, audit + "R"))
                if initial in KEEP[state]:
                    moves.append((i + 1, KEEP[state][initial], cost + fault, audit + "K"))
        # The least initial is looked at first, of those that can still reach the least cost.
        stack += sorted((m for m in moves if m[2] + least[m[0]][m[1]] <= most), key=lambda m: m[3], reverse=True)
    return best


def tabulate(rows: list[tuple[str, int]], opens: bool, closes: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state behind, cost, audit) of a block; ``opens`` and ``closes``: it is a conversation's first or last."""
    out = []
    for start in (START,) if opens else range(4):
        for end in (ENDS,) if closes else [(e,) for e in range(4)]:
            if found := cheapest(rows, start, end):
                out.append((start, end[0], *found))
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by the checksum of conversation and turn: dropped, emptied, cut, repeated or with another role."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


def _order(conv: str = "conv_id") -> list[Column]:
    return [F.col(conv).asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("mark").asc()]


BLOCK = (
    "conv_id long, part int, no int, n long, opens string, closes string, low long, high long, first_turn long, last_turn long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, moves array<struct<a:int,b:int,cost:long,audit:string>>"
)
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _block(conv: int | None, part: int, no: int, rows: list[dict], opens: bool, closes: bool) -> dict:
    faults = [GONE if r["blank"] or not r["first"] else TRUNCATED if r["cut"] else CLEAN for r in rows]
    initials = [r["role"][:1] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    moves = tabulate(list(zip(initials, faults, strict=True)), opens, closes)
    return {
        "conv_id": conv, "part": part, "no": no, "n": len(rows), "opens": initials[0], "closes": initials[-1], "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)), "blank": sum(r["blank"] for r in rows), "duplicate": sum(not r["blank"] and not r["first"] for r in rows),
        "truncated": sum(f == TRUNCATED for f in faults), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "moves": [{"a": a, "b": b, "cost": c, "audit": x} for a, b, c, x in moves],
    }


def blocks(damaged: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The blocks of all conversations, searched: BLOCK."""
    ink = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    slim = damaged.select("conv_id", "turn", "role", F.md5("text").alias("mark"), (ink == "").alias("blank"), ((ink != "") & ~ink.isin(".", "!", "?")).alias("cut"))
    # Equal rows may take either place: the number tells them apart, so that many of them are no one task's work.
    rows = written(slim, "conversation-rows").withColumn("place", F.monotonically_increasing_id())
    earliest = F.min_by("place", F.struct(F.col("turn").isNotNull(), "turn", "place"))
    firsts = rows.groupBy("conv_id", "role", "mark").agg(earliest.alias("place")).select("place", F.lit(True).alias("first"))
    order = [*_order(), F.col("place").asc()]
    told = rows.join(firsts, "place", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    dealt = told.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "blank", "cut", "first")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema([
            ("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("n", pa.int64()), ("opens", pa.string()), ("closes", pa.string()), *[(c, pa.int64()) for c in ("low", "high", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")],
            ("moves", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
        ])
        held: list[dict] = []
        out: list[dict] = []
        no, opens = 0, False  # the first conversation of a task may have begun in the one before
        for batch in batches:
            for row in batch.to_pylist():
                other = bool(held) and held[0]["conv_id"] != row["conv_id"]
                if other or len(held) == block_rows:
                    out.append(_block(held[0]["conv_id"], part, no, held, opens, other))
                    held, no, opens = [], no + 1, other
                held.append(row)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if held:
            out.append(_block(held[0]["conv_id"], part, no, held, opens, False))
        yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(search, BLOCK)


def _combine(conv: int | None, parts: Iterator[dict]) -> dict:
    """The summary of a conversation from its blocks in turn."""
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    reach: dict[int, tuple[int, str]] = {START: (0, "")}
    low = high = closes = None
    turns, last = 0, None
    for part in parts:
        for name in total:
            total[name] += part[name]
        total["illegal"] += closes is not None and closes + part["opens"] not in ("su", "ua", "au")
        closes = part["closes"]
        if part["turns"]:
            turns += part["turns"] - (part["first_turn"] == last)
            low, high, last = part["low"] if low is None else low, part["high"], part["last_turn"]
        after: dict[int, tuple[int, str]] = {}
        for m in part["moves"]:
            if m["a"] in reach:
                found = (reach[m["a"]][0] + m["cost"], reach[m["a"]][1] + m["audit"])
                if m["b"] not in after or found < after[m["b"]]:
                    after[m["b"]] = found
        reach = after
    cost, audit = min(reach[s] for s in ENDS if s in reach)
    return {"conv_id": conv, "gaps": high - low + 1 - turns if turns else 0, **total, "cost": cost, "audit": audit}


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Runs of rows of one conversation, streamed."""
    rows = (r for b in batches for r in b.to_pylist())
    yield from itertools.groupby(rows, key=lambda r: r["conv_id"])


def summaries(found: DataFrame) -> DataFrame:
    """One row for each conversation with rows: faults, cost and audit, from blocks()."""
    types = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, parts in _groups(batches):
            out.append(_combine(conv, parts))
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, types)
                out = []
        yield pa.RecordBatch.from_pylist(out, types)

    return found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(run, SUMMARY)


def repaired(rows: Iterator[dict], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of what is left of the rows after the edits of an audit."""
    state = START
    for edit in audit:
        if edit == "I":
            state = DUE[state]
            yield ("user" if state == U else "assistant"), ""
            continue
        row = next(rows)
        if edit == "K":
            state = KEEP[state][row["role"][:1]]
            yield row["role"], row["text"]
        elif edit == "R":
            state = DUE[state]
            yield ("user" if state == U else "assistant"), row["text"]


def repair(conversations: DataFrame, damaged: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every conv_id of ``conversations`` with the faults of its rows in ``damaged``, the cheapest edits and a digest of what they leave."""
    of = F.col("conv_id").cast("long").alias("conv_id")
    rows = damaged.select(of, F.col("turn").cast("long").alias("turn"), "role", "text")
    done = written(summaries(written(blocks(rows, block_rows), "conversation-blocks")), "conversation-audits")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    lines = {"turn": "long", "role": "string", "mark": "string", "text": "string"}
    null = lambda names: [F.lit(None).cast(t).alias(c) for c, t in names.items()]
    none = {**dict.fromkeys(numbers, "long"), "audit": "string"}
    known = conversations.select(of).distinct().select("conv_id", F.lit(0).alias("kind"), *null(lines), *null(none))
    told = done.select("conv_id", F.lit(1).alias("kind"), *null(lines), *numbers, "audit")
    texts = rows.withColumn("mark", F.md5("text")).select("conv_id", F.lit(2).alias("kind"), *lines, *null(none))
    order = _order()
    dealt = known.unionByName(told).unionByName(texts).repartition("conv_id").sortWithinPartitions(order[0], "kind", *order[1:]).drop("turn", "mark")
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in numbers], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, group in _groups(batches):
            row = {"conv_id": conv, **dict.fromkeys(numbers, 0), "audit": ""}
            digest, n = hashlib.sha256(), 0
            for r in group:
                if r["kind"] == 0:
                    continue
                row |= {c: r[c] for c in (*numbers, "audit")}
                for role, text in repaired(group, r["audit"]):
                    digest.update(f"{chr(10) * bool(n)}{role}:{text}".encode())
                    n += 1
                break
            out.append(row | {"repaired_sha256": digest.hexdigest()})
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
