import datetime
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixloom.llm import fixity, media, urlfilter


@pytest.mark.parametrize("encode", [media.encode_pgm, media.encode_bmp])
def test_stored_samples_come_back(encode):
    rng = np.random.default_rng(0)
    for shape in ((1, 64), (7, 64), (5, 3), (4, 1)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(encode(image)) == image).all()


def test_other_netpbm_kinds():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    with pytest.raises(ValueError, match="truncated|buffer"):
        media.decode(b"P5 9 9 255\nabc")


def test_area_resize_is_the_mean_of_areas():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (12, 18)).astype(np.uint8)
    want = image.reshape(4, 3, 6, 3).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 4, 6), want)
    fine = np.kron(image, np.ones((5, 7)))
    assert np.allclose(media.area_resize(image, 5, 7), media.area_resize(fine, 5, 7))
    assert np.allclose(media.area_resize(image[:1, :1], 8, 9), image[0, 0])


def test_payload_and_features(spark):
    texts = [None, "", "a", "x" * 64, "é" * 33, "long " * 5000, "x" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tile", F.lit("mine"))
    got = {r["doc_id"]: r for r in media.digest(media.media_features(media.store_texts(df))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        data += bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"]) == (len((t or "").encode()), len(data))
        assert got[i]["payload_sha256"] == hashlib.sha256(data).hexdigest()
        stored = b"P5\n64 %d\n255\n" % (len(data) // 64) + data
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert got[i]["tail_crc32"] == zlib.crc32(data[-64:])
        fine = np.kron(np.frombuffer(data, np.uint8).reshape(-1, 64).astype(float), np.ones((8, 9)))  # cells are whole blocks of it
        cells = fine.reshape(8, len(fine) // 8, 9, 64).mean(axis=(1, 3))
        assert got[i]["feature"] == np.packbits(cells[:, :-1] < cells[:, 1:] - 1e-9).tobytes().hex()
    assert got[3][1:] == got[6][1:] and got[0][1:] == got[1][1:]
    one_pass = media.digest_texts(df).drop("tile").collect()
    assert sorted(map(tuple, one_pass)) == sorted(map(tuple, got.values()))
    assert media.store_texts(df.filter("false")).collect() == []


def test_broken_media_give_messages(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"BMxx"), (4, b"P5 2 2 255\nabcd"), (5, b"P9 1 1")], "id long, media binary")
    got = {r["id"]: r for r in media.media_features(df).collect()}
    assert got[1]["error"] is None and got[1]["tile"] is None
    assert all(got[i]["error"] for i in (2, 3, 5)) and got[4]["error"] is None
    assert np.load(io.BytesIO(got[4]["tile"])).shape == (media.TILE, media.TILE)


@pytest.mark.parametrize("content", [b"P5 99999999999 99999999999 255\nx", b"P4 99999999999 9\nx", b"P4 999999999 999999999\nx", b"P2 1 1 255 " + b"9" * 21, b"P5 1 1 0\nx", b"P3 1 1 0 1 2 3", b"P5 0 4 255\n", b"P2 1 1 255 -3", b"BM" + b"\xff\x7f" * 40, b"BM" + b"\0" * 8 + b"\x36\0\0\0\x28\0\0\0" + b"\xff\xff\xff\x7f" * 2 + b"\1\0\x20\0" + b"\0" * 40])
def test_bad_headers_are_messages(content):
    found = media.features(content)
    assert found[:5] == (None,) * 5 and found[5]


def test_samples_above_the_maximum():
    assert media.decode(b"P2 2 1 15\n20 15").tolist() == [[255, 255]] and media.decode(b"P5 1 1 15\n\xff").tolist() == [[255]]


def test_bmp_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "one " * 99), (2, None)], "doc_id long, text string")
    both = [{r["doc_id"]: r for r in media.digest_texts(df, form).collect()} for form in ("pgm", "bmp")]
    for d in (1, 2):
        same = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "tile_sha256")
        assert [both[0][d][c] for c in same] == [both[1][d][c] for c in same] and both[1][d]["media_bytes"] == both[0][d]["payload_bytes"] + 1078


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_fixity_finds_each_damage(spark):
    rng = random.Random(3)
    ids = rng.sample(range(100_000), 120)
    rows = [(i, f"http://h/{i}", "b" * rng.randrange(50)) for i in ids] + [(None, "u", "x"), (-5, "u", None), (7_000_000, None, ""), (ids[0], "twice", "t")]
    other = {r: r for r in map(tuple, rows)}
    changed, lost = rows[5], rows[9]
    replica = [(changed[0], changed[1], changed[2] + "!") if r == changed else r for r in other if r != lost] + [(123_456, "new", "n")]
    got = {r["page_id"]: r for r in fixity.audit(pages(spark, rows), pages(spark, replica)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {changed[0]: "changed", lost[0]: "missing", 123_456: "extra"}
    before = [r for r in rows if r[0] is not None and r[0] >> 12 == lost[0] >> 12 and r[0] < lost[0]]
    size = lambda r: len(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {r[1] or ''}\r\nWARC-Record-ID: <urn:page:{r[0]}>\r\nContent-Length: {len(r[2] or '')}\r\n\r\n{r[2] or ''}\r\n\r\n")
    assert got[lost[0]]["record_offset"] == sum(map(size, before)) and got[lost[0]]["record_bytes"] == size(lost)
    in_replica = [r for r in replica if r[0] is not None and r[0] >> 12 == changed[0] >> 12 and r[0] < changed[0]]
    assert got[changed[0]]["replica_offset"] == sum(map(size, in_replica)) and got[lost[0]]["replica_offset"] is None and got[123_456]["record_offset"] is None
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert fixity.audit(pages(spark, rows), pages(spark, shuffled)).collect() == []


def test_fixity_of_null_and_empty_replicas(spark):
    one = pages(spark, [(None, "u", "x"), (1, "u", "x")]).withColumn("hash", F.lit(1))
    none = pages(spark, [])
    assert {(r["page_id"], r["status"]) for r in fixity.audit(one, none).collect()} == {(None, "missing"), (1, "missing")}
    assert fixity.audit(none, none).collect() == []


def test_url_rules_follow_their_dates(spark):
    day = lambda m, d: datetime.date(2024, m, d)
    entries = [
        ("host", "a.example.com", "block", day(1, 10)), ("host", "a.example.com", "allow", day(3, 1)), ("host", "a.example.com", "remove", day(5, 1)),
        ("domain", "example.com", "block", day(2, 1)), ("prefix", "a.example.com/ok", "allow", day(1, 1)), ("host", "b.org", "block", day(6, 1)), ("host", "b.org", "allow", day(6, 1)),
        (None, "x", "block", day(1, 1)), ("host", "a.example.com", "bogus", day(1, 1)), ("host", "a.example.com", None, day(1, 1)),
    ]
    lists = spark.createDataFrame(entries, "kind string, pattern string, verdict string, listed_on date")
    captures = [
        (1, "http://a.example.com/x", day(1, 9)), (2, "http://A.example.com/x", day(1, 10)), (3, "http://a.example.com:80/x", day(3, 1)), (4, "https://u@a.example.com", day(5, 2)),
        (5, "http://a.example.com/ok/1", day(2, 2)), (6, "http://b.org/", day(6, 1)), (7, None, day(6, 1)), (8, "nonsense", day(6, 1)), (9, "http://b.org/", None), (2, "http://A.example.com/x", day(1, 10)), (None, "http://c.example.com/", day(2, 1)),
    ]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched_on date").withColumn("verdict", F.lit("?")).withColumn("kind", F.lit("?"))
    rows = urlfilter.evaluate(df, lists).collect()
    assert len(rows) == len(captures) and "kind" in rows[0].asDict()
    got = {r["page_id"]: (r["verdict"], r["rule_kind"]) for r in rows}
    assert got == {
        1: ("allow", None), 2: ("block", "host"), 3: ("allow", "host"), 4: ("block", "domain"), 5: ("allow", "prefix"), 6: ("allow", "host"),
        7: ("allow", None), 8: ("allow", None), 9: ("allow", None), None: ("block", "domain"),
    }
    assert urlfilter.evaluate(df.filter("false"), lists).collect() == []
    assert {r["verdict"] for r in urlfilter.evaluate(df, lists.filter("false")).collect()} == {"allow"}


def test_url_plan_is_native(spark):
    df = spark.createDataFrame([(1, "http://a.b/", datetime.date(2024, 1, 1))], "page_id long, url string, fetched_on date")
    lists = spark.createDataFrame([("host", "a.b", "block", datetime.date(2024, 1, 1))], "kind string, pattern string, verdict string, listed_on date")
    plan = urlfilter.evaluate(df, lists)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_roots_vouch_for_offsets_but_not_for_what_precedes(spark):
    rows = [(i, "u", "x" * (i % 7)) for i in range(300)]
    grown = lambda some: {r["node"]: (r["bytes"], r["hash"]) for r in fixity.grow(fixity.leaves(pages(spark, some), "a")).collect()}
    whole, lost = grown(rows), grown([r for r in rows if r[0] != 100])
    assert {n for n in whole if whole[n] != lost[n]} == {100 >> fixity.FAN_OUT_BITS}
    longer = grown([(i, u, h + "!" * (i == 5)) for i, u, h in rows])
    assert {n for n in whole if whole[n] != longer[n]} == {0} and longer[0][0] == whole[0][0] + 1
