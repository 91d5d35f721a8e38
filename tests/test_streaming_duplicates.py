import random

import pytest
from pyspark.sql import functions as F

from helixloom import schema
from helixloom.operators import dedup
from helixloom.options import Options
from helixloom.streaming import duplicates

REFERENCES = [("c", 600), ("d", 600)]
END = ("end", None, -1, None, -1, 0, None, "", True, False, False, True, False, False, False, True, None, None, None, 1 << 50)


def records(seed, n):
    """Pairs with duplicates, some without a mate, some of one name at two places, in the order of place."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        ref, pos = rng.choice("cd"), rng.randrange(500)
        mate, ops = pos + rng.choice([0, 20, 20, 90]), [{"op": "M", "len": rng.choice([10, 11])}]
        nh, name = rng.choice([1, 1, 2, None]), f"n{i // 2 if i % 9 == 0 else i}"
        one = (name, ref, pos, ref, mate, mate - pos + 10, ops, "I" * 10, True, False, True, True, True, False, True, True, nh, None, "10")
        two = (name, ref, mate, ref, pos, pos - mate - 10, ops, "I" * 10, True, False, True, True, True, True, False, False, nh, None, "10")
        rows += [one, two] if i % 7 else [one]
    rows.sort(key=lambda r: (r[1], r[2]))
    return [(*r, k) for k, r in enumerate(rows)]


def run(spark, tmp_path, parts, width, delay):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema.ALIGNMENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema.ALIGNMENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = duplicates.write_sorted(duplicates.collapse_stream(stream, REFERENCES, delay=delay, width=width), str(tmp_path / "out"), str(tmp_path / "ck"))
    finished = query.awaitTermination(240)
    progress = query.lastProgress
    query.stop()
    assert finished
    return spark.read.parquet(str(tmp_path / "out")).collect(), progress


@pytest.mark.parametrize(("width", "delay", "shuffled"), [(1000, 0, False), (64, 2000, True)])
def test_stream_of_duplicates_equals_the_batch(spark, tmp_path, width, delay, shuffled):
    rows = records(5, 120)
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    if shuffled:
        random.Random(3).shuffle(parts)
    got, progress = run(spark, tmp_path, [*parts, [END]], width, delay)
    want = dedup.fragments_of(spark.createDataFrame(rows, schema.ALIGNMENTS), Options()).collect()
    key = lambda r: (r["ref"], r["name"], r["hi"], r["a"], r["b"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 40
    assert sum(s.numRowsTotal for s in progress.stateOperators) == 0
    for ref in "cd":
        starts = [r["pos1"] for r in sorted((r for r in got if r["ref"] == ref), key=lambda r: (r["batch"], r["pos1"]))]
        assert width < 1000 or starts == sorted(starts)


def test_frontier_waits_for_the_leftmost_mate():
    row = lambda arrival, pos, mate: (arrival, pos, mate, 10, 1, "10M", "{}")
    waiting, kept = {}, {}
    duplicates.add(waiting, kept, [(("x", 0, 5, 90), row(0, 5, 90)), (("y", 0, 7, 20), row(1, 7, 20)), (("y", 0, 7, 20), row(2, 20, 7))])
    assert duplicates.release(waiting, kept, 50) == ([], [], 91)
    assert duplicates.release(waiting, kept, 91) == ([("x", 0, 5, 90)], [(7, 20, 10, "10M", "10M")], None)


def test_state_is_kept_in_pieces():
    """A group of many entries costs a few values of state, not a call for each."""
    entries = {(i, i + 20, 30, "10M", "10M"): (int(i % 3 > 0), i, f"n{i}", 0, '{"x":1}', None) for i in range(10_000)}
    pieces = duplicates.packed(entries)
    assert len(pieces) == 3 and duplicates.unpacked(pieces) == entries and duplicates.packed({}) == []
    assert duplicates.plain(duplicates.pd.Series([1, None, 3])) == [1, None, 3]
