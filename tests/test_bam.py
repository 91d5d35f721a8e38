import os
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from helixloom import schema
from helixloom.sources import bam, blobs

REFERENCES = [("chr1", 3_000_000), ("chr.2", 500_000)]


def rows_of(n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ref, pos, size = rng.choice(["chr1", "chr1", "chr.2"]), rng.randrange(480_000), rng.randrange(5, 90)
        cigar = [{"op": "M", "len": size}] if i % 3 else [{"op": "M", "len": 2}, {"op": "N", "len": rng.randrange(1, 40_000)}, {"op": "M", "len": size - 2}]
        qual = "".join(chr(33 + rng.randrange(60)) for _ in range(size))
        rows.append((f"r{i}", ref, pos, ref, pos + 50, 60, cigar, qual, True, i % 5 == 0, True, i % 4 > 0, True, i % 2 == 0, i % 2 == 1, i % 3 == 0, rng.randrange(1, 300), i if i % 2 else None, f"{size}", i))
    return rows


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "x")
    bam.register(spark)
    rows = rows_of(6000)
    bam.write(spark.createDataFrame(rows, schema.ALIGNMENTS).coalesce(1), path, REFERENCES, 1 << 17)
    return path, rows


def test_what_is_written_is_read_back_in_order(spark, held):
    path, rows = held
    files = bam.files_of(path)
    assert len(files) > 3
    for split in (1 << 30, 20_000):
        got = spark.read.format("bam").option("splitBytes", split).load(path).collect()
        assert sorted(tuple(r)[:-1] for r in got) == sorted(spark.createDataFrame(rows, schema.ALIGNMENTS).drop("arrival").rdd.map(tuple).collect())
    order = {"chr1": 0, "chr.2": 1}
    places = [(order[r["ref"]], r["pos"]) for f in files for r in spark.read.format("bam").load(f).orderBy("arrival").collect()]
    assert places == sorted(places)


def test_region_reads_only_its_blocks(spark, held, tmp_path):
    path, rows = held
    bam.write(spark.createDataFrame(rows, schema.ALIGNMENTS).coalesce(1), str(tmp_path / "one"), REFERENCES)
    whole = spark.read.format("bam").load(str(tmp_path / "one"))
    region = whole.filter("ref = 'chr1' AND pos >= 100000 AND pos < 103000")
    before = sorted(map(tuple, region.collect()))
    bam.index(spark, str(tmp_path / "one"))
    assert sorted(map(tuple, region.collect())) == before and len(before) > 10
    assert sorted(map(tuple, whole.filter("ref = 'chr.2' AND pos = 77").collect())) == sorted(map(tuple, whole.filter("concat(ref, '') = 'chr.2' AND pos + 0 = 77").collect()))
    assert whole.filter("ref = 'chr1' AND pos > 5 AND pos < 3").count() == 0 and whole.filter("ref = 'chr9'").count() == 0
    reader = bam.BamReader({"path": str(tmp_path / "one")})
    list(reader.pushFilters([EqualTo(("ref",), "chr1"), GreaterThanOrEqual(("pos",), 100_000), LessThan(("pos",), 103_000)]))
    file = bam.files_of(str(tmp_path / "one"))[0]
    with open(file, "rb") as f:
        all_blocks = sum(1 for _ in bam.blocks(bam._open(file), 0, os.path.getsize(file)))
    asked = sum(1 for p in reader.partitions() for o, _ in bam.blocks(bam._open(file), p.start, os.path.getsize(file)) if o << 16 < p.until)
    assert 0 < 2 * asked < all_blocks


def test_index_is_in_the_public_format(spark, held):
    path, rows = held
    bam.index(spark, path)
    for file in bam.files_of(path):
        found = bam.read_index(open(file + ".bai", "rb").read())
        assert len(found) == len(REFERENCES)
        names = [n for n, _ in REFERENCES]
        for part in bam.records(bam.Range(file, names, *bam.header(file)[1:2], os.path.getsize(file) << 16, bam.header(file)[2])):
            low = part[2]
            high = low + sum(c["len"] for c in part[6]) - 1
            assert any(a <= part[-1] < b for a, b in bam.chunks_of(found[names.index(part[1])], low, low)) and any(a <= part[-1] < b for a, b in bam.chunks_of(found[names.index(part[1])], high, high))


def test_every_split_starts_at_the_first_record(tmp_path):
    """Random qualities and tags, cut at every place of a file of small blocks."""
    rng = random.Random(8)
    data, number = b"", {n: i for i, (n, _) in enumerate(REFERENCES)}
    names = [n for n, _ in REFERENCES]
    columns = schema.ALIGNMENTS.split(", ")
    for r in rows_of(60, 5):
        row = dict(zip([c.split(" ")[0] for c in columns], r, strict=True))
        body = bam.encode(row, number)[4:] + b"ZBBC" + struct.pack("<I", 40) + bytes(rng.choice([0, 1, 255, 33, rng.randrange(256)]) for _ in range(40))
        data += struct.pack("<i", len(body)) + body
    head = b"BAM\1" + struct.pack("<ii", 0, 2) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 9) for n in names)
    path = str(tmp_path / "x.bam")
    content = b"".join(bam.compressed((head + data)[at : at + 400]) for at in range(0, len(head + data), 400)) + bam.END_BLOCK
    open(path, "wb").write(content)
    whole = list(bam.records(bam.Range(path, names, 0, len(content) << 16, len(head))))
    assert len(whole) == 60
    for cut in range(len(head), len(content), 37):
        parts = [bam.Range(path, names, 0, cut << 16, len(head)), bam.Range(path, names, cut, len(content) << 16, -1)]
        assert [r for p in parts for r in bam.records(p)] == whole, cut


def test_stream_goes_on_from_its_checkpoint(spark, held, tmp_path):
    path, rows = held

    def run():
        stream = spark.readStream.format("bam").option("maxBytesPerTrigger", 60_000).option("progress", str(tmp_path / "progress")).option("splitBytes", 9_000).load(path)
        query = stream.select("name", F.col("arrival").alias("place")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()
        return query

    query = run()
    while not query.recentProgress and query.isActive:
        query.awaitTermination(1)
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() < len(rows)
    query = run()
    for _ in range(120):
        query.awaitTermination(1)
        if spark.read.parquet(str(tmp_path / "out")).count() >= len(rows):
            break
    query.stop()
    got = sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r[0] for r in rows)


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "x")
    some = spark.range(8).select(F.concat(F.lit("f"), "id").alias("name"), F.encode(F.lit("x"), "UTF-8").alias("content"))
    bad = some.withColumn("content", F.when(F.col("name") == "f6", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        blobs.write(bad.repartition(4), path)
    assert blobs.committed(path) == [] and blobs.read(spark, path).count() == 0
    assert not [f for _, _, names in os.walk(path) for f in names]
    blobs.write(some.repartition(3), path)
    blobs.write(some.limit(1), path)
    assert sorted(r["name"] for r in blobs.read(spark, path).collect()) == sorted([f"f{i}" for i in range(8)] + ["f0"])


def test_records_of_a_batch_are_those_of_its_rows(spark):
    import numpy as np
    import pyarrow as pa

    rng, rows = random.Random(8), []
    number = {"a": 0, "b": 1}
    for i in range(300):
        ops = [{"op": rng.choice("MIDNSHP=X"), "len": rng.randrange(1, 40_000)} for _ in range(rng.randrange(4))]
        flags = {c: rng.random() < 0.5 for c in ("is_paired", "is_qcfail", "is_mapped", "is_primary", "mate_mapped", "is_rev", "mate_rev", "is_first")}
        row = {"name": "n" * rng.randrange(1, 9) + str(i), "ref": rng.choice(["a", "b", None]), "pos": rng.choice([-1, 5, 16_380, 1 << 25]) + rng.randrange(2), "mate_ref": rng.choice(["a", "b", None]), "mate_pos": i, "insert_size": rng.choice([None, -7, 9]), "cigar": rng.choice([ops, ops, None]), "qual": "".join(chr(33 + rng.randrange(60)) for _ in range(rng.randrange(6))), "md": rng.choice([None, "", "5A4"]), "nh": rng.choice([None, 1, 3]), "hi": rng.choice([None, 0]), "arrival": i}
        rows.append(row | flags)
    kinds = pa.schema([(c, pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())])) if c == "cigar" else pa.string() if c in ("name", "ref", "mate_ref", "qual", "md") else pa.bool_() if c.startswith("is_") or c in ("mate_mapped", "mate_rev") else pa.int64() if c == "arrival" else pa.int32()) for c in rows[0]])
    batch = pa.RecordBatch.from_pylist(rows, schema=kinds)
    for lo, hi in ((0, 300), (17, 180), (299, 300), (5, 5)):
        data, ends = bam.encode_all(batch.slice(lo, hi - lo), number)
        want = [bam.encode(r, number) for r in rows[lo:hi]]
        assert data.tobytes() == b"".join(want) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_files_are_indexed_by_one_pass(spark, tmp_path, monkeypatch):
    rows = [(f"r{i}", "a", i * 30, "a", i * 30, 9, [{"op": "M", "len": 9}], "I" * 9, True, False, True, True, True, False, True, True, 1, None, "9", i) for i in range(3000)]
    path = str(tmp_path / "many")
    bam.write(spark.createDataFrame(rows, schema.ALIGNMENTS).coalesce(1), path, [("a", 100_000)], 1 << 15)
    made, create = [], spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **b: made.append(a) or create(*a, **b))
    bam.index(spark, path)
    files = bam.files_of(path)
    assert len(made) == 1 and len(files) > 3
    found = spark.read.format("bam").load(path).filter("ref = 'a' AND pos >= 30000 AND pos < 60000")
    assert sorted(r["pos"] for r in found.collect()) == list(range(30_000, 60_000, 30))
    assert all(bam.read_index(open(f"{f}.bai", "rb").read()) for f in files)
