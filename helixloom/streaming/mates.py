"""Mate pairing over a stream of alignment records.

State is kept for each read name, so it is dealt evenly over tasks; a first mate waits
in it until its second arrives or ``patience`` has passed. Which of several duplicates
survives depends on records that may still come, so duplicates are collapsed in batches
over the pairs written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_MATE = "struct<arrival:bigint,pos:int,mate_pos:int,cigar:array<struct<op:string,len:int>>,insert_size:int,qual:string,md:string,nh:int>"
_FIELDS = ["arrival", "pos", "mate_pos", "cigar", "insert_size", "qual", "md", "nh"]
PAIRS = f"ref string, bucket string, name string, hi int, a {_MATE}, b {_MATE}"
_STATE = "arrival long, pos int, mate_pos int, cigar string, insert_size int, qual string, md string, nh int"


def _pack(ops) -> str:
    return "".join(f"{o['len']}{o['op']}" for o in ops)


def _unpack(text: str) -> list[dict]:
    out, n = [], ""
    for c in text:
        if c.isdigit():
            n += c
        else:
            out.append({"op": c, "len": int(n)})
            n = ""
    return out


def _pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, patience_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = sorted((r for f in frames for r in f[_FIELDS].to_dict("records")), key=lambda r: r["arrival"])
    waiting = None
    if state.exists:
        waiting = dict(zip(_FIELDS, state.get, strict=True))
        waiting["cigar"] = _unpack(waiting["cigar"])
    out = []
    for r in rows:
        if waiting is not None and r["mate_pos"] == waiting["pos"] and waiting["mate_pos"] == r["pos"]:
            out.append((*key[:4], waiting, r))
            waiting = None
        else:
            waiting = r
    if waiting is None:
        if state.exists:
            state.remove()
    else:
        state.update(tuple(_pack(waiting[f]) if f == "cigar" else waiting[f] for f in _FIELDS))
        if patience_ms:
            state.setTimeoutDuration(patience_ms)
    if out:
        yield pd.DataFrame(out, columns=["ref", "bucket", "name", "hi", "a", "b"])


def pair_stream(records: DataFrame, patience_ms: int | None = 600_000) -> DataFrame:
    """Pairs (ref, bucket, name, hi, a, b) of a streaming table with the columns of alignments and bucket; hi is not null.

    Without patience a first mate waits for ever, and the stream can end when all is read.
    """

    def run(key, frames, state):
        return _pair(key, frames, state, patience_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if patience_ms else GroupStateTimeout.NoTimeout
    ends = {"low": F.least("pos", "mate_pos"), "high": F.greatest("pos", "mate_pos")}
    return records.select("ref", "bucket", "name", "hi", *_FIELDS).withColumns(ends).groupBy("ref", "bucket", "name", "hi", "low", "high").applyInPandasWithState(run, PAIRS, _STATE, "append", timeout)
