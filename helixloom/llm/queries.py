"""Queries over the given tables, one for each operator, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm import crosstokens, decontam, fixity, jaccard, langid, linededup, media, mixing, quality, repair, suffixdedup, urlfilter, wavelet
from helixloom.llm._shared import shared_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw(*key: Column | str) -> Column:
    """A number below 2**32 from the md5 of the joined strings."""
    return F.conv(F.substring(F.md5(F.concat(*[k if isinstance(k, Column) else F.lit(k) for k in key])), 1, 8), 16, 10).cast("long")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from two thirds of the documents."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(langid.fold(3) != 1))
    found = langid.identify(docs, model)
    return found.select("doc_id", (langid.fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; folds 0 and 1 fit, 3 calibrates, 2 is held out."""
    measured = written(quality.statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    known = quality.labelled(measured.filter(langid.fold(4) != 2), table(spark, sf_dir, "labels"))
    model = quality.fit(known.filter(langid.fold(4) < 2), known.filter(langid.fold(4) == 3))
    scored = quality.score(measured, model)
    return scored.select("doc_id", (langid.fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by sets of 4-word shingles, at 85 % of their union."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), jaccard.Measure(words=4, percent=85))


def op4_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage between the archive of pages and a replica, located by Merkle trees."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity.audit(pages, fixity.damaged(pages))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for hosts, domains and prefixes found in the captures."""
    keys = pages.select(F.explode(urlfilter.lookup_keys(F.col("url"))).alias("key")).select("key.kind", "key.pattern").distinct()
    keys = keys.filter((F.col("kind") != "domain") | F.col("pattern").contains(".")).filter(draw("keepkind", F.col("pattern")) % 3 != 0)
    dated = keys.withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("k", F.concat("kind", F.lit("|"), "pattern", F.lit("|"), F.col("n").cast("string")))
    verdict = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), (draw("verdict", F.col("k")) % 3 + 1).cast("int"))
    return dated.select("kind", "pattern", verdict.alias("verdict"), F.date_add(F.lit("2024-01-01").cast("date"), (draw("day", F.col("k")) % 366).cast("int")).alias("listed_on"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, how many repeat an earlier run, and the digest of what is kept."""
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return found.select("doc_id", "n_lines", "n_removed", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_bytes"), kept.alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture against the list entries active on its fetch day."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (draw("fetch", F.col("url")) % 366).cast("int")))
    found = urlfilter.evaluate(captures, list_entries(pages))
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "rule_from")})


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as greymaps, read back, resized to NPY tiles and hashed."""
    return media.digest_texts(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without 50-byte strings of earlier documents."""
    return suffixdedup.dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document so that sources take their target words."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens, and how common the links are."""
    return crosstokens.counted(table(spark, sf_dir, "documents"), crosstokens.Files(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest edits that mend damaged conversations."""
    whole = table(spark, sf_dir, "conversations")
    return repair.repair(whole, repair.damage(whole))


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; nothing is copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op13_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text from shard files of wavelet matrices, in the order of documents."""
    path = f"{shared_dir(spark)}/helixloom/token-shards-{uuid.uuid4().hex}"
    wavelet.write(table(spark, sf_dir, "documents"), path, wavelet.WordTokenizer(tokenizer_file("word_bpe_49k.json")))
    return wavelet.read(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_quality": op2_quality,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_fixity": op4_fixity,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_media": op7_media,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_shards": op13_token_shards,
}


#: Tables as views; functions that both engines share are written out. Tabs of numbers: see draw().
_DRAW = "cast(('0x' || substr(md5({0}), 1, 8)) as bigint)"

ORACLE_SQL: dict[str, str] = {}

_record = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))::varchar || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
ORACLE_SQL["op4_fixity"] = f"""
WITH drawn AS (SELECT *, {_DRAW.format("'replica' || page_id::varchar")} AS d FROM pages),
kinds AS (SELECT *, CASE WHEN d % 31 = 0 THEN (d // 31) % 4 ELSE -1 END AS kind FROM drawn),
spoilt AS (SELECT page_id, url, CASE kind WHEN 0 THEN substr(html, 1, 40) WHEN 1 THEN '?' || html ELSE html END AS html FROM kinds WHERE kind <> 2 UNION ALL SELECT -page_id - 1, url, html FROM kinds WHERE kind = 3),
a AS (SELECT page_id, sha256({_record}) AS sha, octet_length(encode({_record})) AS n FROM pages),
b AS (SELECT page_id, sha256({_record}) AS sha, octet_length(encode({_record})) AS n FROM spoilt),
pa AS (SELECT *, sum(n) OVER (PARTITION BY floor(page_id / 4096.0) ORDER BY page_id) - n AS o FROM a),
pb AS (SELECT *, sum(n) OVER (PARTITION BY floor(page_id / 4096.0) ORDER BY page_id) - n AS o FROM b)
SELECT coalesce(pa.page_id, pb.page_id) AS page_id, CASE WHEN pb.page_id IS NULL THEN 'missing' WHEN pa.page_id IS NULL THEN 'extra' ELSE 'changed' END AS status, floor(coalesce(pa.page_id, pb.page_id) / 4096.0)::bigint AS file_no,
  pa.o::bigint AS record_offset, pa.n::bigint AS record_bytes, pb.o::bigint AS replica_offset, pb.n::bigint AS replica_bytes, pa.sha AS sha256
FROM pa FULL JOIN pb ON pa.page_id = pb.page_id WHERE pb.sha IS DISTINCT FROM pa.sha
"""

ORACLE_SQL["op6_url_filter"] = f"""
WITH parsed AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS seg,
    date '2024-01-01' + ({_DRAW.format("'fetch' || url")} % 366)::int AS fetched_on FROM pages),
keys AS (
  SELECT page_id, 'host' AS kind, host AS pattern, 1000 AS rank FROM parsed WHERE host <> ''
  UNION ALL SELECT page_id, 'prefix', host || '/' || seg, 1001 FROM parsed WHERE host <> '' AND seg <> ''
  UNION ALL SELECT page_id, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'), len(string_split(host, '.')) - i + 1
  FROM (SELECT page_id, host, unnest(range(1, len(string_split(host, '.')))) AS i FROM parsed WHERE host <> '')),
listed AS (SELECT DISTINCT kind, pattern FROM keys WHERE (kind <> 'domain' OR contains(pattern, '.')) AND {_DRAW.format("'keep' || 'kind' || pattern")} % 3 <> 0),
dated AS (SELECT kind, pattern, kind || '|' || pattern || '|' || n::varchar AS k FROM listed, range(3) t(n)),
entries AS (SELECT kind, pattern, ({_DRAW.format("'verdict' || k")} % 3)::int AS rank, date '2024-01-01' + ({_DRAW.format("'day' || k")} % 366)::int AS listed_on FROM dated),
daily AS (SELECT kind, pattern, listed_on, max(rank) AS rank FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(listed_on) OVER (PARTITION BY kind, pattern ORDER BY listed_on) AS until FROM daily),
hits AS (
  SELECT k.page_id, k.kind, k.pattern, s.rank AS verdict, s.listed_on, row_number() OVER (PARTITION BY k.page_id ORDER BY k.rank DESC) AS place
  FROM keys k JOIN parsed p USING (page_id) JOIN spans s ON s.kind = k.kind AND s.pattern = k.pattern
    AND p.fetched_on >= s.listed_on AND (s.until IS NULL OR p.fetched_on < s.until) WHERE s.rank < 2)
SELECT p.page_id, p.url, p.fetched_on::varchar AS fetched_on, CASE WHEN h.verdict = 0 THEN 'block' ELSE 'allow' END AS verdict,
  h.kind AS rule_kind, h.pattern AS rule_pattern, h.listed_on::varchar AS rule_from
FROM parsed p LEFT JOIN (SELECT * FROM hits WHERE place = 1) h USING (page_id)
"""

_npy = io.BytesIO()
np.save(_npy, np.zeros((media.TILE, media.TILE), np.uint8))
#: What stands before the samples of a tile.
_npy_head = _npy.getvalue()[: -media.TILE**2].hex()

#: Payload and stored form; the checksum bit by bit; and the cells of the difference hash as overlaps of sample rows and columns with an 8 x 9 grid.
ORACLE_SQL["op7_media"] = f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, greatest(1, (octet_length(b) + 63) // 64) AS h, hex(b) || repeat('00', (greatest(1, (octet_length(b) + 63) // 64) * 64 - octet_length(b))::int) AS x FROM t),
f AS (SELECT *, unhex(x) AS payload, encode('P5' || chr(10) || '64 ' || h::varchar || chr(10) || '255' || chr(10)) || unhex(x) AS media FROM p),
rows_of AS (SELECT doc_id, h, r, substr(x, (r * 128 + 1)::int, 128) AS line FROM p, unnest(range(h)) u(r)),
sums AS (SELECT doc_id, h, r, list_transform(range(9), lambda j: list_sum(list_transform(range(64), lambda i: ('0x' || substr(line, (2 * i + 1)::int, 2))::int * greatest(0, least((j + 1) * 64, (i + 1) * 9) - greatest(j * 64, i * 9))))) AS across FROM rows_of),
grid AS (SELECT doc_id, k, j, sum(across[j + 1] * greatest(0, least((k + 1) * h, (r + 1) * 8) - greatest(k * h, r * 8))) AS v FROM sums, range(8) g(k), range(9) c(j) WHERE greatest(k * h, r * 8) < least((k + 1) * h, (r + 1) * 8) GROUP BY ALL),
bits AS (SELECT a.doc_id, a.k, sum(CASE WHEN a.v < b.v THEN 1 << (7 - a.j)::int ELSE 0 END) AS byte FROM grid a JOIN grid b ON a.doc_id = b.doc_id AND a.k = b.k AND b.j = a.j + 1 GROUP BY ALL),
hash AS (SELECT doc_id, string_agg(printf('%02x', byte::int), '' ORDER BY k) AS feature FROM bits GROUP BY doc_id),
pairs AS (SELECT doc_id, h, r, list_transform(range(32), lambda j: ('0x' || substr(line, (4 * j + 1)::int, 2))::int + ('0x' || substr(line, (4 * j + 3)::int, 2))::int) AS two FROM rows_of),
cells AS (SELECT doc_id, h, k, j, sum(two[j + 1] * greatest(0, least((k + 1) * h, (r + 1) * 32) - greatest(k * h, r * 32))) AS v FROM pairs, range(32) g(k), range(32) c(j) WHERE greatest(k * h, r * 32) < least((k + 1) * h, (r + 1) * 32) GROUP BY ALL),
tile AS (SELECT doc_id, sha256(unhex('{_npy_head}' || string_agg(printf('%02x', ((v + h) // (2 * h))::int), '' ORDER BY k, j))) AS tile_sha256 FROM cells GROUP BY doc_id),
crc AS (SELECT doc_id, list_reduce(list_prepend(4294967295::bigint, list_transform(range(64), lambda i: ('0x' || substr(x, (length(x) - 127 + 2 * i)::int, 2))::bigint)),
  lambda c, v: list_reduce(list_prepend(xor(c, v), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda q, z: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384::bigint) ELSE q >> 1 END)) AS c FROM p)
SELECT f.doc_id, n AS n_bytes, h * 64 AS payload_bytes, sha256(payload) AS payload_sha256, xor(c, 4294967295::bigint) AS tail_crc32, octet_length(media) AS media_bytes, sha256(media) AS media_sha256, feature, tile_sha256
FROM f JOIN tile ON tile.doc_id = f.doc_id JOIN crc ON crc.doc_id = f.doc_id JOIN hash ON hash.doc_id = f.doc_id
"""
_trim = "regexp_replace({0}, '^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$', '', 'g')"
ORACLE_SQL["op5_line_dedup"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, {_trim.format("line")} AS x FROM l),
k AS (SELECT doc_id, place, x, len(regexp_extract_all(x, '[^ \\x09-\\x0D]+')) AS words FROM t WHERE x <> ''),
o AS (SELECT *, row_number() OVER w AS i, lead(x) OVER w AS x2, lead(x, 2) OVER w AS x3, lead(words) OVER w AS w2 FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
g AS (
  SELECT doc_id, i, 1 AS size, x AS a, NULL AS b, NULL AS c FROM o WHERE words >= 50
  UNION ALL SELECT doc_id, i, 2, x, x2, NULL FROM o WHERE x2 IS NOT NULL AND words + w2 >= 50
  UNION ALL SELECT doc_id, i, 3, x, x2, x3 FROM o WHERE x3 IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY size, a, b, c ORDER BY doc_id, i) AS nth FROM g),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(size)) AS i FROM r WHERE nth > 1),
m AS (SELECT t.doc_id, t.place, t.line, o.i, gone.i IS NOT NULL AS cut FROM t LEFT JOIN o USING (doc_id, place) LEFT JOIN gone ON gone.doc_id = o.doc_id AND gone.i = o.i),
d AS (SELECT doc_id, count(i) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT cut), '') AS kept FROM m GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_lines, 0)::int AS n_lines, coalesce(n_removed, 0)::int AS n_removed, octet_length(encode(coalesce(kept, ''))) AS kept_bytes, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents x LEFT JOIN d USING (doc_id)
"""

ORACLE_SQL["op3_jaccard_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 3)) AS s FROM w, unnest(range(1, greatest(2, len(w) - 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

#: Costs and audits of the four states as one string each, ten digits before the audit, so that the least string is the best.
_step = lambda v, cost, edit: f"(printf('%010d', substr({v}, 1, 10)::int + {cost}) || substr({v}, 11) || '{edit}')"
_crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::bigint)), lambda c, v: list_reduce(list_prepend(xor(c, v), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda q, z: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384::bigint) ELSE q >> 1 END)), 4294967295::bigint)"
_due_u = lambda cost, edit: ", ".join(_step(v, cost, edit) for v in ("none", "s", "a"))
ORACLE_SQL["op12_conversation_repair"] = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ink FROM d),
t AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN ink = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN ink NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
f AS (SELECT *, fault IN ('', 'truncated') AS stays, (fault = 'truncated')::int AS more FROM t),
w AS (
  SELECT conv_id, 0::bigint AS i, '0000000000' AS none, NULL::varchar AS s, NULL::varchar AS u, NULL::varchar AS a FROM f GROUP BY conv_id
  UNION ALL SELECT n.conv_id, n.i, {_step("none", 3, "D")}, least({_step("s", 3, "D")}, CASE WHEN stays AND r = 's' THEN {_step("none", "more", "K")} END),
    least({_step("u", 3, "D")}, CASE WHEN stays THEN least({_due_u("2 + more", "R")}) END, CASE WHEN stays AND r = 'u' THEN least({_due_u("more", "K")}) END),
    least({_step("a", 3, "D")}, CASE WHEN stays THEN {_step("u", "2 + more", "R")} END, CASE WHEN stays AND r = 'a' THEN {_step("u", "more", "K")} END)
  FROM (SELECT conv_id, i, none, s, u, least(a, {_step("u", 2, "I")}) AS a FROM (SELECT conv_id, i, none, s, a, least(u, {_due_u(2, "I")}) AS u FROM w)) x JOIN f n ON n.conv_id IS NOT DISTINCT FROM x.conv_id AND n.i = x.i + 1),
e AS (SELECT conv_id, least(none, a, {_step("u", 2, "I")}) AS best FROM (SELECT conv_id, none, a, least(u, {_due_u(2, "I")}) AS u FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
m AS (SELECT conv_id, substr(best, 1, 10)::bigint AS cost, substr(best, 11) AS audit FROM e),
p AS (SELECT conv_id, p, substr(audit, p::int, 1) AS edit, length(replace(substr(audit, 1, p::int), 'I', '')) AS i FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM m)),
left_over AS (SELECT p.conv_id, p.p, edit, f.role, f.r, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.p) - 1 AS j FROM p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND edit <> 'I' WHERE edit <> 'D'),
due AS (SELECT *, j - max(CASE WHEN j = 0 AND edit = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS nth FROM left_over),
h AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM due GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(cost, 0)::bigint AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""
