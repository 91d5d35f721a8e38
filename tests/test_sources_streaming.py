import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from helixloom import schema
from helixloom.operators import dedup
from helixloom.sources import bam
from helixloom.streaming import mates


def bgzf(data, size):
    out = b""
    for at in [*range(0, len(data), size), None]:
        raw = b"" if at is None else data[at : at + size]
        c = zlib.compressobj(wbits=-15)
        body = c.compress(raw) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))
    return out


def record(name, ref, pos, flag, mate, mate_pos, insert, cigar, n, tags):
    ops = b"".join(struct.pack("<I", (k << 4) | "MIDNSHP=X".index(o)) for k, o in cigar)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 0, 0, len(cigar), flag, n, mate, mate_pos, insert) + name.encode() + b"\0" + ops + bytes((n + 1) // 2) + bytes([40] * n) + tags
    return struct.pack("<i", len(body)) + body


@pytest.mark.parametrize(("block", "split"), [(60_000, 1 << 20), (700, 2_000), (150, 400)])
def test_bam(spark, tmp_path, block, split):
    rng = random.Random(4)
    names = ["chr1", "chr.2"]
    data = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(x) + 1) + x.encode() + b"\0" + struct.pack("<i", 1000) for x in names)
    want = []
    for i in range(300):
        nh, pos, n = rng.randrange(1, 200), rng.randrange(900), rng.randrange(5, 60)
        tags = b"NHC" + bytes([nh]) + b"MDZ" + str(n).encode() + b"\0" + b"ZBBS" + struct.pack("<I", 2) + b"abcd" + (b"HIi" + struct.pack("<i", 3) if i % 2 else b"")
        data += record(f"r{i}", i % 2, pos, 99, i % 2, pos + 50, 60, [(n, "M")], n, tags)
        want.append((f"r{i}", names[i % 2], pos, nh, 3 if i % 2 else None, str(n), "I" * n))
    path = tmp_path / "x.bam"
    path.write_bytes(bgzf(data, block))
    bam.register(spark)
    df = spark.read.format("bam").option("splitBytes", split).load(str(path))
    rows = df.orderBy("arrival").collect()
    assert [(r["name"], r["ref"], r["pos"], r["nh"], r["hi"], r["md"], r["qual"]) for r in rows] == want
    assert rows[0]["is_paired"] and rows[0]["is_first"] and rows[0]["mate_rev"] and not rows[0]["is_rev"]
    assert split > 10_000 or df.rdd.getNumPartitions() > 5


def test_stream_of_mates_equals_the_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        pos, mate = rng.randrange(500), rng.randrange(500)
        ops = [{"op": "M", "len": 10}]
        both = [(f"n{i}", "c", pos, "c", mate, 5, ops, "I" * 10, True, False, True, True, True, False, True, True, 1, 0, "10"), (f"n{i}", "c", mate, "c", pos, -5, ops, "I" * 10, True, False, True, True, True, True, False, False, 1, 0, "10")]
        rows += both if i % 7 else both[:1]
    rng.shuffle(rows)
    rows = [(*r, k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, schema.ALIGNMENTS).withColumn("bucket", F.lit("."))
    for k in range(3):
        df.filter(F.col("arrival") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = mates.pair_stream(stream, None).writeStream.format("memory").queryName("mates").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    finished = query.awaitTermination(90)
    query.stop()
    assert finished
    key = lambda r: (r["name"], r["a"]["pos"], r["b"]["pos"])
    got = {(n, *sorted((p, q))) for n, p, q in map(key, spark.table("mates").collect())}
    want = {(n, *sorted((p, q))) for n, p, q in map(key, dedup.pair_mates(df, ["ref", "bucket"]).collect())}
    assert got == want and len(got) == 51


def test_three_records_of_a_name_pair_alike_in_stream_and_batch(spark, tmp_path):
    ops = [{"op": "M", "len": 10}]
    rows = [(f"n{i}", "c", 7, "c", 7, 5, ops, "I" * 10, True, False, True, True, True, k == 1, k != 1, k == 0, 1, 0, "10", 10 * i + k) for i in range(6) for k in range(i)]
    df = spark.createDataFrame(rows, schema.ALIGNMENTS).withColumn("bucket", F.lit("."))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = mates.pair_stream(stream, None).writeStream.format("memory").queryName("triples").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    finished = query.awaitTermination(90)
    query.stop()
    assert finished
    key = lambda r: (r["name"], r["a"]["arrival"], r["b"]["arrival"])
    got = sorted(map(key, spark.table("triples").collect()))
    assert got == sorted(map(key, dedup.pair_mates(df, ["ref", "bucket"]).collect()))
    assert got == [("n2", 20, 21), ("n3", 30, 31), ("n4", 40, 41), ("n4", 42, 43), ("n5", 50, 51), ("n5", 52, 53)]
