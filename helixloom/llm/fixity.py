"""WARC fixity audit with Merkle trees.

Pages are serialised as WARC response records. Leaves of a tree are the digests of the
records of one id and the bytes they take, inner nodes the digest of at most 16 children in the order of
ids, which is the order of the records, and of the range of offsets that each child has
in its parent. So a root vouches for every record and for where it stands, while a lost or longer
record changes its own ancestors and not what follows it. Replicas are compared
from the roots; at each level only children of nodes that differ are looked at, until
the leaves that differ remain, with their offsets in both replicas.

Ids need not be dense: a node covers a range of ids, so a lost record changes its own
leaf and ancestors alone. Nulls: a null url or html is an empty string; records with a
null id form one leaf of their own, id null in the result. Records that share an id
form one leaf whose digest doesn't depend on their order. Empty replicas and extra
columns are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm._shared import written

FAN_OUT_BITS = 4
#: Ids of one archive file; offsets count from the file's start.
FILE_BITS = 12
_NO_ID = -(1 << 62)


def warc_record(url: Column, record_id: Column, body: Column) -> Column:
    """A WARC/1.1 response record with its block and closing line breaks."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame, replica: str) -> DataFrame:
    """One row for each id: its digest, the number of records and their bytes.

    The digest is over sums of the words of the records' SHA-256, so that any number of
    records with one id are pre-aggregated before the shuffle.
    """
    record = warc_record(F.col("url"), F.col("page_id"), F.col("html"))
    hashed = records.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("node"), F.sha2(F.encode(record, "UTF-8"), 256).alias("sha"), F.octet_length(record).cast("long").alias("n"))
    word = lambda i: F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("long")
    sums = hashed.groupBy("node").agg(*[F.sum(word(i)).alias(f"w{i}") for i in range(8)], F.count(F.lit(1)).alias("records"), F.sum("n").alias("bytes"), F.min("sha").alias("sha"))
    digest = F.sha2(F.concat_ws("|", F.col("records").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(8)]), 256)
    return sums.select(F.lit(replica).alias("replica"), "node", digest.alias("hash"), "records", "bytes", "sha")


def grow(below: DataFrame) -> DataFrame:
    """The next level: a node's hash covers its children's ids, offset ranges in the node, and hashes, in order."""
    children = F.sort_array(F.collect_list(F.struct("node", "bytes", "hash")))
    up = below.groupBy("replica", F.shiftright("node", FAN_OUT_BITS).alias("up")).agg(children.alias("children"), F.sum("bytes").alias("bytes"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(s: Column, c: Column) -> Column:
        part = F.concat_ws(":", c["node"].cast("string"), s["at"].cast("string"), c["bytes"].cast("string"), c["hash"])
        return F.struct((s["at"] + c["bytes"]).alias("at"), F.concat(s["parts"], F.array(part)).alias("parts"))

    text = F.array_join(F.aggregate("children", start, add, lambda s: s["parts"]), "|")
    return up.select("replica", F.col("up").alias("node"), "bytes", F.sha2(text, 256).alias("hash"))


def differing(level: DataFrame) -> DataFrame:
    """Nodes whose hash differs between the replicas or that one of them lacks."""
    side = lambda r: F.max(F.when(F.col("replica") == r, F.col("hash")))
    both = level.groupBy("node").agg(side("a").alias("hash_a"), side("b").alias("hash_b"))
    return both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Leaves that differ: page_id, status (changed, missing, extra), file_no, record_offset, record_bytes, replica_offset, replica_bytes, sha256."""
    base = written(leaves(primary, "a").unionByName(leaves(replica, "b")), "fixity-leaves")
    low, high = base.filter(F.col("node") != _NO_ID).agg(F.min("node"), F.max("node")).first()
    levels, top = [base.select("replica", "node", "bytes", "hash")], max(abs(low or 0), abs(high or 0))
    while top:
        top >>= FAN_OUT_BITS
        levels.append(written(grow(levels[-1]), "fixity-level"))
    bad = differing(levels[-1]).select("node")
    for level in reversed(levels[:-1]):
        parents = bad.select(F.col("node").alias("parent"))
        bad = differing(level.join(parents, F.shiftright(level["node"], FAN_OUT_BITS) == F.col("parent"), "left_semi")).select("node")
    # Offsets are worked out in the files that hold damage, not in all.
    bad = written(bad, "fixity-damage")
    files = bad.select(F.shiftright("node", FILE_BITS).alias("__file")).distinct()
    base = base.join(files, F.shiftright(base["node"], FILE_BITS) == files["__file"], "left_semi")
    in_file = Window.partitionBy("replica", F.shiftright("node", FILE_BITS)).orderBy("node")
    placed = base.withColumn("offset", F.sum("bytes").over(in_file) - F.col("bytes"))
    a = placed.filter("replica = 'a'").select("node", F.col("offset").alias("record_offset"), F.col("bytes").alias("record_bytes"), F.col("records").alias("records_a"), F.col("sha").alias("sha256"))
    b = placed.filter("replica = 'b'").select("node", F.col("offset").alias("replica_offset"), F.col("bytes").alias("replica_bytes"), F.col("records").alias("records_b"))
    status = F.when(F.col("records_a").isNull(), "extra").when(F.col("records_b").isNull(), "missing").otherwise("changed")
    found = bad.join(a, "node", "left").join(b, "node", "left")
    page_id = F.when(F.col("node") != _NO_ID, F.col("node"))
    return found.select(page_id.alias("page_id"), status.alias("status"), F.shiftright(page_id, FILE_BITS).alias("file_no"), "record_offset", "record_bytes", "replica_offset", "replica_bytes", "sha256")


def damaged(records: DataFrame, every: int = 31) -> DataFrame:
    """A replica with deterministic damage: of every so many ids one is lost, cut short, altered, or there a second time under an id below 0."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("replica"), F.col("page_id").cast("string"))), 1, 8), 16, 10).cast("long")
    kind = F.when(draw % every == 0, F.floor(draw / every) % 4).otherwise(F.lit(-1))
    html = F.when(kind == 0, F.substring("html", 1, 40)).when(kind == 1, F.concat(F.lit("?"), F.col("html"))).otherwise(F.col("html"))
    extra = records.filter(kind == 3).withColumn("page_id", -F.col("page_id") - 1)
    return records.filter((kind != 2) | F.col("page_id").isNull()).withColumn("html", html).unionByName(extra)
