"""Conversation repair against a search that is written another way."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from helixloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged_plainly(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repaired_plainly(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        ink = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]

    @functools.lru_cache(None)
    def best(i, made):
        """The least (cost, audit) of what follows, when the initials so far are as ``made`` (its last two are enough)."""
        options = [(0, "")] if i == len(rows) and (made == "" or made.endswith("a")) else []
        due = "u" if not made or made[-1] in "sa" else "a"
        step = lambda cost, edit, rest: None if rest is None else (cost + rest[0], edit + rest[1])
        if i < len(rows):
            more = faults[i] == "truncated"
            options.append(step(3, "D", best(i + 1, made)))
            if faults[i] in ("", "truncated"):
                options.append(step(2 + more, "R", best(i + 1, due)))
                if initials[i] == due or initials[i] == "s" and not made:
                    options.append(step(int(more), "K", best(i + 1, initials[i])))
        if deep[0] < 3:
            deep[0] += 1
            options.append(step(2, "I", fresh(i, due)))
            deep[0] -= 1
        options = [o for o in options if o]
        return min(options) if options else None

    deep = [0]

    @functools.lru_cache(None)
    def fresh(i, made):
        """As best(), with fewer inserts to come: three in a row are never cheapest."""
        return best.__wrapped__(i, made)

    cost, audit = best(0, "") if rows else (0, "")
    left, i, due = [], 0, "u"
    for edit in audit:
        if edit != "I":
            role, text = rows[i][2:]
            i += 1
        if edit == "D":
            continue
        if edit in "RI":
            role, text = {"u": "user", "a": "assistant"}[due], "" if edit == "I" else text
        left.append((role, text))
        due = "a" if role[:1] == "u" else "u"
    assert LEGAL.fullmatch("".join(r[:1] for r, _ in left))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()


def check(spark, rows, block_rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"kind": F.lit(9), "mark": F.lit("x"), "copy": F.lit(3)}).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df, repair.damage(df), block_rows).collect()}
    by = {}
    for r in damaged_plainly(rows):
        by.setdefault(r[0], []).append(r)
    assert got == {c: repaired_plainly(by.get(c, [])) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("block_rows", [256, 2])
def test_repair_against_another_search(spark, block_rows):
    rng, rows = random.Random(5), []
    for conv in range(70):
        for turn in range(rng.randrange(1, 12)):
            text = rng.choice(["Yes.", "Well", "Go on!", "  ", "", "More?\n", f"Own {turn}.", None, "Same."])
            rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    rows += [(None, t, "user", "No id.") for t in range(4)] + [(500, None, "user", "When?"), (500, None, "assistant", "Never."), (500, 3, "user", "Then?")]
    check(spark, rows, block_rows)


def test_a_conversation_with_most_rows_lies_in_many_blocks(spark):
    rng = random.Random(9)
    rows = [(1, t, "user" if t % 2 == 0 or rng.random() < 0.1 else "assistant", f"Line {t if rng.random() < 0.9 else 7}." * rng.randrange(1, 3)) for t in range(700)]
    check(spark, [*rows, (2, 0, "user", "Hello."), (2, 1, "assistant", "Hi." * 50_000)], 16)


def test_empty_table_and_conversations_without_rows_left(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA), repair.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    gone = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Bye.")], SCHEMA)
    assert [tuple(r) for r in repair.repair(df, repair.damage(df)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_search_follows_only_prefixes_that_can_be_cheapest():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice("suatx"), rng.choice([repair.CLEAN, repair.CLEAN, repair.TRUNCATED, repair.GONE])) for _ in range(rng.randrange(9))]
        for start in range(4):
            for ends in (repair.ENDS, (repair.U,), (repair.S,)):
                best, edge = {(0, start): [(0, "")]}, [(0, start, 0, "")]
                while edge:  # all edits, without bounds or tables but for a limit on inserts
                    i, s, cost, audit = edge.pop()
                    moves = [(i, repair.DUE[s], cost + 2, audit + "I")] if not audit.endswith("II") else []
                    if i < len(rows):
                        moves.append((i + 1, s, cost + 3, audit + "D"))
                        if rows[i][1] != repair.GONE:
                            moves.append((i + 1, repair.DUE[s], cost + 2 + rows[i][1], audit + "R"))
                            if rows[i][0] in repair.KEEP[s]:
                                moves.append((i + 1, repair.KEEP[s][rows[i][0]], cost + rows[i][1], audit + "K"))
                    for m in moves:
                        if not best.get(m[:2]) or (m[2], m[3]) < best[m[:2]][0]:
                            best[m[:2]] = [(m[2], m[3])]
                            edge.append(m)
                want = min((best[len(rows), e][0] for e in ends if (len(rows), e) in best), default=None)
                assert repair.cheapest(rows, start, ends) == want
