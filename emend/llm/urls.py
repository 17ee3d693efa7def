"""URL filters: host-suffix and path-prefix expressions of each URL meet rules on short hash prefixes; whole digests and precedence decide.

A rule is a host and the start of a path. A URL has one expression for each of its host's suffixes (at label borders) and each start of its
path that a rule can have: up to a slash, or of the length of a rule that doesn't end in one. As an expression deeper than every rule meets none,
the rules' greatest number of labels and slashes bound what is expanded, and nothing that could match is left out.
The join is on the first 8 hex digits of an expression's SHA-256; a match counts if all 64 agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, joined_by_key, table

#: The contract's rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Verdict where no rule fits.
DEFAULT = "allow"
#: Hex digits of a digest on which expressions and rules meet.
SHORT = 8
#: Rules up to this number go to all executors (72 bytes each at most); more are joined by shuffles, hot expressions apart.
MOST_BROADCAST = 200_000
#: The long that ranks matches: characters of the rule, then of its host, then block over allow.
_HOST_BITS, _HOST_SPAN = 2, 1 << 24


def _lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to a slash, question mark, hash sign or the end; path: on to a question mark, hash sign or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    none = F.lit("")
    return F.coalesce(_lower(host), none), F.coalesce(F.substring(rest, F.length(host) + 1, F.length(rest)), none)


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def compiled(rules: DataFrame) -> DataFrame:
    """rules (verdict, rule) -> digest, short, verdict_bit, host, path, by host and path; a rule with both verdicts blocks, one without a host fits nothing."""
    host = _lower(F.substring_index("rule", "/", 1))
    path = F.substring(F.col("rule"), F.length(F.substring_index("rule", "/", 1)) + 1, F.length("rule"))
    known = rules.where("rule is not null and verdict in ('allow', 'block')").select(host.alias("host"), path.alias("path"), (F.col("verdict") == "block").cast("long").alias("blocks"))
    known = known.where("host <> ''").groupBy("host", "path").agg(F.max("blocks").alias("blocks"))
    digest = F.sha2(F.concat("host", "path"), 256)
    return known.select("host", "path", "blocks", digest.alias("digest"), F.left(digest, F.lit(SHORT)).alias("short"))


def expressions(urls: DataFrame, labels: int, slashes: int, lengths: list[int]) -> DataFrame:
    """urls with host_chars, path_chars, digest and short: a row for each host suffix and path start that a rule can have, or one of nulls."""
    each = urls.withColumn("labels", F.explode_outer(F.when(F.col("host") != "", F.sequence(F.lit(1), F.least(_count(F.col("host"), ".") + 1, F.lit(labels))))))
    suffix = F.expr("substring_index(host, '.', -labels)")
    # starts of the path by their length: 0, those that end in a slash, those that are as long as a rule's
    to_slash = lambda j: F.when(j > 0, F.length(F.call_function("substring_index", F.col("path"), F.lit("/"), j)) + 1).otherwise(0)
    starts = F.transform(F.sequence(F.lit(0), F.least(_count(F.col("path"), "/"), F.lit(slashes))), to_slash)
    if lengths:
        starts = F.array_distinct(F.concat(starts, F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))))
    each = each.select(*urls.columns, suffix.alias("suffix"), F.explode(starts).alias("path_chars"))
    each = each.select(*urls.columns, F.length("suffix").alias("host_chars"), "path_chars", F.sha2(F.concat("suffix", F.left("path", F.col("path_chars"))), 256).alias("digest"))
    return each.withColumn("short", F.left("digest", F.lit(SHORT)))


def _strength(host_chars: Column, path_chars: Column, blocks: Column) -> Column:
    """Longer rules are stronger; of equal ones that with the longer host."""
    return ((host_chars + path_chars).cast("long") * _HOST_SPAN + host_chars) * _HOST_BITS + blocks


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict; a row each.

    rules (verdict, rule): allow or block, and a host with the start of a path, as in `example.net/en/`. A rule fits its host and all subdomains, if the path starts
    with the rule's; the longest rule wins, of equally long ones that with the longer host. Where none fits, rule is null and
    the verdict is the default. A null url, or one without ://, has an empty host and path, and no rule fits it, as none fits an empty host. Ports and user names are part of
    the host. Repeated rows and null ids are rows as any other; empty tables, of rules too, are allowed. Other columns don't matter. Hosts have less than 2^24 characters.
    """
    known = durable(compiled(rules), "rules")
    n, labels, slashes = known.agg(F.count("*"), F.coalesce(F.max(_count(F.col("host"), ".") + 1), F.lit(0)), F.coalesce(F.max(_count(F.col("path"), "/")), F.lit(0))).first()
    # as many lengths as the longest rule has characters, at most
    lengths = sorted(r[0] for r in known.where("path <> '' and right(path, 1) <> '/'").select(F.length("path")).distinct().collect())
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    by_row = urls.columns
    listed = known.select("short", F.col("digest").alias("whole"), "blocks")
    fits = F.when(F.col("digest") == F.col("whole"), _strength(F.col("host_chars"), F.col("path_chars"), F.col("blocks")))
    if n <= most_broadcast:
        met = expressions(urls, max(labels, 1), slashes, lengths).join(F.broadcast(listed), "short", "left").select(*by_row, fits.alias("best"))
    else:
        urls = durable(urls, "urls")
        found = expressions(urls, labels, slashes, lengths)
        # rules that some URL meets, with how many expressions do
        hit = durable(listed.join(found.where("short is not null").groupBy("short").agg(F.count("*").alias("rows")), "short"), "met")
        met = joined_by_key(found, hit, "short", "rows").select(*by_row, fits.alias("best")).union(urls.withColumn("best", F.lit(None).cast("long")))
    best = met.groupBy(*by_row).agg(F.max("best").alias("best"))
    code = F.floor(F.col("best") / _HOST_BITS)
    host_chars, chars = code % _HOST_SPAN, F.floor(code / _HOST_SPAN)
    rule = F.when(F.col("best").isNotNull(), F.concat(F.right("host", host_chars), F.left("path", chars - host_chars)))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best") % _HOST_BITS == 1, F.lit("block")).otherwise(F.lit("allow"))
    return best.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, rule string"))


OP11_SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
cut AS (SELECT page_id, regexp_extract(t, '^[^?#]*') AS t FROM rest),
urls AS (SELECT page_id, translate(regexp_extract(t, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(t, length(regexp_extract(t, '^[^/]*')) + 1) AS path FROM cut),
rules(verdict, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
numbered AS (SELECT row_number() OVER () AS no, * FROM urls),
best AS (SELECT no, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY no)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN best USING (no)
"""
