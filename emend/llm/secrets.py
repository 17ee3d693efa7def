"""Secret scans over an incremental ledger of blobs. DataFrame functions only.

Every text is a blob, addressed by its SHA-256. The ledger says which blobs were scanned under which rule versions and what was
found; a scan reads the texts of blobs that lack a rule version, once each, however many paths (documents) hold them,
adds to the ledger, and joins the findings back to all paths. An unchanged corpus is scanned at no cost; a changed rule
scans all blobs for that rule alone.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_released
from .common import durable, run_dir


@dataclass(frozen=True)
class Rule:
    """kind; pattern; the group whose length counts, and the least length; a test that costs less than the pattern and misses none."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1

    @property
    def name(self) -> str:
        """Kind, version, and a digest of what the rule does, so that a pattern that was changed without a new version is a new rule."""
        what = hashlib.sha256(f"{self.pattern}\0{self.group}\0{self.least}".encode()).hexdigest()
        return f"{self.kind}/{self.version}/{what[:8]}"


#: The three kinds of the contract, in its order, then further ones.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 1, 6, r"(?i)(?:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ[A-Za-z0-9_-]+\."),
)
BASE = ("assign", "access", "hex")

_SPAN = "array<struct<start:bigint,end:bigint,kind:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(values: Column) -> Column:
    """A long array in about as many parts as each has elements, so that work in the square of a part's length stays small."""
    k = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    cut = lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / k).cast("int")), lambda c: F.slice(values, c * k + 1, k))
    return F.when(F.size(values) > 0, _let(k, cut)).otherwise(F.array(values))


def _scan(values: Column, op) -> Column:
    """op over each element and all before it; values are numbers from 0 up."""
    none = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("bigint"))
    each = lambda part: F.aggregate(part, none, lambda acc, x: F.concat(acc, F.array(op(last(acc), x.cast("bigint")))))

    def joined(local: Column) -> Column:
        return _let(each(F.transform(local, last)), lambda ends: F.flatten(F.transform(local, lambda part, c: F.transform(part, lambda v: F.when(c == 0, v).otherwise(op(F.get(ends, c - 1), v))))))

    return _let(F.transform(_parts(values), each), joined)


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of the rule that are long enough, in code points, end exclusive.

    Splitting by the pattern gives the pieces between the matches, so that ends are sums of lengths.
    """
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), F.length)
    none = F.lit(None).cast(_SPAN)

    def found(v: Column) -> Column:
        ends = _scan(F.zip_with(v["all"], F.slice(v["gap"], F.lit(1), F.size(v["all"])), lambda a, g: a + g), lambda a, b: a + b)
        each = F.transform(F.arrays_zip(ends.alias("end"), v["all"].alias("all"), v["part"].alias("part")), lambda x: F.struct((x["end"] - x["all"]).cast("bigint").alias("start"), x["end"].alias("end"), F.lit(rule.kind).alias("kind"), x["part"].alias("part")))
        kept = F.filter(each, lambda x: x["part"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))

    pieces = F.struct(F.transform(F.split(text, rule.pattern), F.length).alias("gap"), lengths(0).alias("all"), lengths(rule.group).alias("part"))
    return F.when(text.rlike(rule.hint), _let(pieces, found)).otherwise(none)


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"blob binary, rules array<string>, found {_SPAN}").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):  # nothing was scanned yet
            return None
        raise


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """docs (text, ...) -> the same rows and columns with `blob` and `found`, the spans of all rules by start and rule.

    ledger_path: a Parquet folder that is read, if there, and added to; without it the ledger is a new one. Null text counts as empty.
    Repeated rows each get the findings of their blob; null ids and an empty table need nothing special. Columns of docs
    that are named like the two new ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("blob", "found").withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    path = ledger_path or f"{run_dir(spark)}/ledger-{uuid.uuid4().hex}"
    names = F.array(*(F.lit(r.name) for r in rules))
    seen = _ledger(spark, path)
    texts = docs.select("blob", "text")
    if seen is None:
        pending = texts.dropDuplicates(["blob"]).withColumn("todo", names)
    else:
        seen = seen.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("had"))  # one row for each scan of a blob
        todo = docs.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(names, F.coalesce("had", F.array().cast("array<string>"))).alias("todo"))
        todo = durable(todo.where(F.size("todo") > 0), "todo")
        pending = texts.join(todo, "blob").dropDuplicates(["blob"])
    each = [F.when(F.array_contains("todo", r.name), spans(F.col("text"), r)) for r in rules]
    found = F.filter(F.flatten(F.array(*(F.coalesce(x, F.array().cast(_SPAN)) for x in each))), lambda x: x["start"].isNotNull())
    with shuffles_released(spark):
        pending.select("blob", F.col("todo").alias("rules"), found.alias("found")).write.mode("append").parquet(path)
    wanted = reduce(lambda a, b: a | b, ((F.col("x.kind") == r.kind) & F.array_contains("rules", r.name) for r in rules))
    rank = reduce(lambda a, kr: F.when(F.col("x.kind") == kr[1].kind, kr[0]).otherwise(a), enumerate(rules), F.lit(len(rules)))  # by the rules of this call
    hits = _ledger(spark, path).where(F.size("found") > 0).select("blob", "rules", F.explode("found").alias("x")).where(wanted)
    hits = hits.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(F.col("x.start").alias("start"), rank.alias("rank"), F.col("x.end").alias("end"), F.col("x.kind").alias("kind")))).alias("found"))
    hits = hits.withColumn("found", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return docs.join(hits, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(_SPAN)))


def digest(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found span (overlapping ones as one) replaced by the mark."""

    def stretches(upto: Column) -> Column:
        """What lies between the spans: after all spans so far, up to the next one that begins there or later; then the rest."""
        own = F.transform(found, lambda x, i: F.struct(F.when(i > 0, F.get(upto, i - 1)).otherwise(F.lit(0).cast("bigint")).alias("lo"), x["start"].alias("hi")))
        kept = F.filter(own, lambda r: r["hi"] >= r["lo"])
        rest = F.struct(F.get(upto, F.size(upto) - 1).alias("lo"), F.length(text).cast("bigint").alias("hi"))
        return F.concat(kept, F.array(rest))

    def joined(part: Column) -> Column:
        """Stretches of a part, cut from the text between its ends."""
        lo, hi = F.get(part, F.lit(0))["lo"], F.get(part, F.size(part) - 1)["hi"]
        inner = lambda own: F.array_join(F.transform(part, lambda r: F.substring(own, (r["lo"] - lo + 1).cast("int"), (r["hi"] - r["lo"]).cast("int"))), mark)
        return _let(F.substring(text, (lo + 1).cast("int"), (hi - lo).cast("int")), inner)

    ends = _scan(F.transform(found, lambda x: x["end"]), F.greatest)
    done = _let(_let(ends, stretches), lambda s: F.array_join(F.transform(_parts(s), joined), mark))
    return F.when(F.size(found) > 0, done).otherwise(text)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return out.select("doc_id", *map(count, BASE), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))


def _spans_sql(rule: Rule) -> str:
    """(row_no, start, stop, kind) of one rule: pieces between the matches, laid end to end."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT row_no, start, start + length(whole) AS stop, '{rule.kind}' AS kind FROM (
    SELECT row_no, whole, part, sum(length(gap)) OVER w + coalesce(sum(length(whole)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT row_no, generate_subscripts(gaps, 1) AS i, unnest(gaps) AS gap, unnest(wholes) AS whole, unnest(parts) AS part
          FROM (SELECT row_no, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS wholes, regexp_extract_all(t, '{pattern}', {rule.group}) AS parts FROM texts))
    WINDOW w AS (PARTITION BY row_no ORDER BY i))
  WHERE whole IS NOT NULL AND length(part) >= {rule.least}"""


OP10_SQL = (
    "WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row_no FROM documents),\nfound AS ("
    + " UNION ALL ".join(f"SELECT *, {k} AS rank FROM ({_spans_sql(r)})" for k, r in enumerate(RULES))
    + "),\njoined AS (SELECT row_no, "
    + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    + f", string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (WHERE rank < {len(BASE)}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM found GROUP BY row_no)\n"
    + "SELECT doc_id, "
    + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)
    + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN joined USING (row_no)"
)
