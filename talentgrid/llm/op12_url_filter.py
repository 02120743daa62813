"""URL filters by a sort-merge range join: canonical keys, intervals of rules, one sorted sweep.

A canonical key is a host with its labels reversed (``www.example.org``: ``org.example.www``),
followed by the path, as bytes.  A rule (host, path) is the interval of all keys that start with
its own: it opens at its key and closes at its key followed by the byte FF, which no UTF-8 text
holds.  Since a rule also fits subdomains, an address has one key for each number of labels that
some rule's host has.

Rules of one host nest or are apart, so a sorted sweep needs a stack: an opening event pushes its
rule, a closing event pops one.  The stack is kept in two windows over the events: a running sum
of +1 and -1 is its depth, and the last rule that was pushed at that depth is its top.  Addresses
are then merged into the sorted events and take the last top before them.

Distinct (host, path) pairs are swept, not rows, so copies of an address cost nothing.  The keys
of a host with many addresses are dealt into several sweeps, each with all events of that host; a
sweep has as many addresses as events at least (and ``SWEEP_ROWS``), so dealing at most doubles
the rows.  Everything is DataFrame functions: no Python on the executors.

Defined results: a null address, or one without ``://``, has an empty host and path, which no rule
fits; repeated rows are judged each; of two fitting rules the longer (host and path together) wins,
then the one of the longer host; a rule given twice blocks if one of the two does; rules without a
host are not allowed; columns named host, path, rule or verdict are replaced, others stay; an
empty table gives an empty result, and with no rules every address has the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

#: The rules of the query, as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: The verdict on an address that no rule fits.
DEFAULT = "allow"
#: Least number of addresses of one host that are worth a sweep of their own.
SWEEP_ROWS = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Rules as a table (host, path, verdict)."""
    if any(not host or verdict not in ("allow", "block") for host, _, verdict in rules):
        raise ValueError("a rule has a host and the verdict allow or block")
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def events(rules: DataFrame) -> DataFrame:
    """(rev, key, top): at each end of a rule's interval the innermost rule that is open from there on, or null."""
    host = F.translate("host", UPPER, LOWER)
    r = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is after allow
    rule = F.struct(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_chars"))
    r = r.select(_reversed(F.col("host")).alias("rev"), rule.alias("rule"), "path")
    r = r.select("rev", F.encode(F.concat("rev", "path"), "UTF-8").alias("key"), "rule")
    ends = r.select("rev", F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(None).cast(r.schema["rule"].dataType).alias("rule"), F.lit(-1).alias("step"))
    both = r.withColumn("step", F.lit(1)).unionByName(ends)
    so_far = Window.partitionBy("rev").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_depth = Window.partitionBy("rev", "depth").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("depth", F.sum("step").over(so_far))
    return both.select("rev", "key", F.when(F.col("depth") > 0, F.last("rule", ignorenulls=True).over(at_depth)).alias("top"))


def fitting_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, found) of the distinct addresses (host, path) that a rule fits; found: the longest."""
    spark = addresses.sparkSession
    stops = events(rules)
    levels = sorted(r[0] for r in rules.select(_labels(F.col("host"))).distinct().collect())  # label counts: a handful
    if not levels:
        return addresses.limit(0).select("host", "path", F.lit(None).cast("struct<rule: string, verdict: string, host_chars: int>").alias("found"))
    level = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda n: n <= _labels(F.col("host"))))
    keys = addresses.select("host", "path").filter("host <> ''").distinct().select("host", "path", level.alias("n"))
    keys = keys.select("host", "path", _reversed(F.expr("substring_index(host, '.', -n)")).alias("rev"))
    hosts = stops.groupBy("rev").agg(F.count("*").alias("n_events"))
    keys = written(spark, keys.join(hosts, "rev"), "url-keys")
    deals = keys.groupBy("rev").agg(F.ceil(F.count("*") / F.greatest(F.lit(SWEEP_ROWS), F.first("n_events"))).alias("deals"))
    own = keys.join(deals, "rev").select("rev", F.pmod(F.xxhash64("host", "path"), "deals").alias("deal"), F.encode(F.concat("rev", "path"), "UTF-8").alias("key"), "host", "path")
    all_stops = stops.join(deals, "rev").select("rev", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), "key", F.struct("top").alias("stop"))
    merged = all_stops.unionByName(own, allowMissingColumns=True)
    # at one key the event comes first: a rule fits the address that equals it
    sweep = Window.partitionBy("rev", "deal").orderBy("key", F.col("stop").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = merged.select("host", "path", F.last("stop", ignorenulls=True).over(sweep)["top"].alias("top"))
    hits = swept.filter("host IS NOT NULL AND top IS NOT NULL")
    return hits.groupBy("host", "path").agg(F.max_by("top", F.struct(F.length("top.rule"), F.col("top.host_chars"))).alias("found"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Every row of ``pages`` with host, path, the rule that decides (null: none) and the verdict."""
    host, path = split_url(F.col(url))
    split = pages.withColumns({"_host": host, "_path": path})
    found = fitting_rules(split.select(F.col("_host").alias("host"), F.col("_path").alias("path")), rules)
    found = found.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("found").alias("_found"))
    out = split.join(found, ["_host", "_path"], "left")
    new = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_found.rule"), "verdict": F.coalesce("_found.verdict", F.lit(default))}
    return out.select(*[c for c in pages.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the address of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """DuckDB SQL for the same rows: every rule against every distinct address."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rh, rp, v) AS (VALUES {rules}),
b AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2)
SELECT page_id, p.host, p.path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
"""
