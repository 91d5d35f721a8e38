"""URL filters by a temporal list join, in DataFrame operations only.

List entries are dated: a pattern is blocked or allowed from a day on, or removed. They
become validity intervals (one verdict for a pattern and day, ended by its next entry),
and every capture is evaluated against the entries active on its fetch day. A capture
looks up its host, each domain it ends in (itself included) and host plus first path segment; of the active
entries found, the most specific decides (prefix, then host, then the longest domain).

A pattern has at most one entry a day, so its intervals are one sorted array of bounded
size. Patterns and days that captures ask for are made distinct first, with a map-side
part, and each is looked up once in the array of its pattern (the as-of join); what is active then goes back to
the captures by pattern and day, hot ones of which are broadcast. Nulls: a capture
with a null url or day, or a url without host, is kept with verdict ``allow`` and no
rule. Entries with a null pattern, kind, verdict or day are ignored. Of several entries
for one pattern and day, removal beats allow and allow beats block. Repeated captures
are evaluated each; empty tables are fine; other columns of the captures are kept, those
named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm._shared import join_counted, written

#: Order of verdicts on one day.
RANK = {"block": 0, "allow": 1, "remove": 2}


def host_of(url: Column) -> Column:
    """The host in lower case, '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def first_segment(url: Column) -> Column:
    """The first segment of the path, '' if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1), F.lit(""))


def lookup_keys(url: Column) -> Column:
    """Array of (kind, pattern, rank) under which entries may hold for the url."""
    host, segment = host_of(url), first_segment(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parent = lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("pattern"), (n - i + 1).alias("rank"))
    parents = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), parent)).otherwise(F.array().cast("array<struct<kind:string,pattern:string,rank:int>>"))
    one = lambda kind, pattern, rank: F.array(F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(rank).alias("rank")))
    with_path = F.when(segment != "", one("prefix", F.concat(host, F.lit("/"), segment), 1001)).otherwise(F.array().cast("array<struct<kind:string,pattern:string,rank:int>>"))
    found = F.concat(one("host", host, 1000), parents, with_path)
    return F.when(host != "", found)


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, verdict, valid_from and valid_to (exclusive, null: still open)."""
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    known = entries.select("kind", "pattern", F.col("listed_on").cast("date").alias("valid_from"), rank[F.col("verdict")].alias("rank")).dropna()
    daily = known.groupBy("kind", "pattern", "valid_from").agg(F.max("rank").alias("rank"))
    by_day = Window.partitionBy("kind", "pattern").orderBy("valid_from")
    verdict = F.element_at(F.array(*[F.lit(x) for x in RANK]), F.col("rank") + 1)
    held = daily.withColumn("valid_to", F.lead("valid_from").over(by_day)).withColumn("verdict", verdict)
    return held.filter(F.col("verdict") != "remove").select("kind", "pattern", "verdict", "valid_from", "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """The captures with verdict, rule_kind, rule_pattern and rule_from of the entry that decides."""
    results = ["verdict", "rule_kind", "rule_pattern", "rule_from"]
    kept = captures.select([c for c in captures.columns if c not in results])
    dated = intervals(entries).groupBy("kind", "pattern").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "verdict"))).alias("dated"))
    asked = kept.select(F.col(id_col).alias("p_id"), F.col(url_col).alias("p_url"), F.col(day_col).cast("date").alias("day")).distinct()
    probes = asked.withColumn("key", F.explode(lookup_keys(F.col("p_url")))).select("p_id", "p_url", "day", "key.kind", "key.pattern", "key.rank")
    days = probes.filter("day IS NOT NULL").groupBy("kind", "pattern", "day").agg(F.count(F.lit(1)).alias("n"))
    begun = F.try_element_at(F.filter("dated", lambda x: x["valid_from"] <= F.col("day")), F.lit(-1))
    active = days.join(dated, ["kind", "pattern"]).withColumn("entry", begun)
    active = active.filter("entry IS NOT NULL").filter("entry.valid_to IS NULL OR day < entry.valid_to").select("kind", "pattern", "day", "n", "entry.verdict", "entry.valid_from")
    active = written(active, "url-active")
    hits = join_counted(probes, active, ["kind", "pattern", "day"], "n").groupBy("p_id", "p_url", "day").agg(F.max_by(F.struct("verdict", "kind", "pattern", "valid_from"), "rank").alias("rule"))
    out = kept.join(hits, kept[id_col].eqNullSafe(hits["p_id"]) & (kept[url_col] == hits["p_url"]) & (kept[day_col].cast("date") == hits["day"]), "left")
    return out.select(*kept.columns, F.coalesce("rule.verdict", F.lit("allow")).alias("verdict"), F.col("rule.kind").alias("rule_kind"), F.col("rule.pattern").alias("rule_pattern"), F.col("rule.valid_from").alias("rule_from"))
