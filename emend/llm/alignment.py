"""Cross-tokenizer alignment: which tokens of two tokenizers overlap, in groups between their common ends, and how common each overlap is.

Spark deals documents to tasks; each Arrow batch is aligned by DuckDB over tables of token intervals: an ASOF join finds the B token under the start
of each A token, a range join the B tokens that begin inside an A token, window sums number the groups. Partial counts of id pairs are merged
by Spark, and the links of each document meet them there. A text is cut at spaces where both tokenizers begin a token, and
each distinct part of a batch is encoded and aligned once; parts without such a space are cut further at common ends, so that no table is large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, joined_by_key, small_batches, table
from .tokenizers import TOKENIZERS, Encoders, Ragged, encoders, vocabulary_files

#: Tokens of both sides that DuckDB aligns at once, and the bytes of a unit beyond which it is cut at common ends.
MOST_TOKENS, MOST_UNIT = 100_000, 1 << 16
#: Bytes of text of a batch.
BATCH_BYTES = 4 << 20
#: A pair of ids is one number: a * SPAN + b.
SPAN = 1 << 20

_ALIGN = """
CREATE OR REPLACE TABLE covers AS  -- each A token with the B token under its start
  SELECT a.unit, a.i, a.id AS a, b.id AS b, a.s, a.e, a.s = b.s AS cut, b.e < a.e AS more FROM a ASOF JOIN b ON a.s >= b.s;
CREATE OR REPLACE TABLE second AS
  SELECT unit, i, id, s, s IN (SELECT s FROM covers WHERE cut) AS cut FROM b;
CREATE OR REPLACE TABLE inside AS  -- B tokens that begin inside an A token
  SELECT c.unit, c.a, b.id AS b FROM (SELECT * FROM second WHERE NOT cut) b JOIN (SELECT * FROM covers WHERE more) c ON b.s > c.s AND b.s < c.e;
INSERT INTO unit_pairs
  SELECT unit, a::BIGINT * {span} + b, count(*) FROM (SELECT unit, a, b FROM covers UNION ALL SELECT unit, a, b FROM inside) GROUP BY ALL;
"""
_GROUPS = """
WITH tokens AS (SELECT unit, i, a AS id, 0 AS side, cut FROM covers UNION ALL SELECT unit, i, id, 1, cut FROM second),
grouped AS (SELECT unit, i, id, side, sum(cut::INT) OVER w AS no, lead(cut, 1, true) OVER w AS last FROM tokens WINDOW w AS (PARTITION BY side ORDER BY i))
SELECT unit, id || CASE WHEN NOT last THEN ',' WHEN side = 0 THEN '|' ELSE ';' END AS piece, (last AND side = 0)::INT AS ends FROM grouped ORDER BY no, side, i
"""
_LINKS = """
CREATE OR REPLACE TABLE links AS
  SELECT doc, pair, sum(t * n)::BIGINT AS n FROM (SELECT doc, unit, count(*) AS t FROM held GROUP BY ALL) JOIN unit_pairs USING (unit) GROUP BY doc, pair
"""


def _whole(ids: Ragged, entries: Ragged, parts: list[bytes]) -> np.ndarray:
    """Which parts the joined bytes of their tokens give back, with a space before."""
    total = np.concatenate(([0], np.cumsum(entries.sizes()[ids.values])))[ids.start]
    want = Ragged.of([b" " + p for p in parts], np.uint8)
    ok = np.diff(total) == want.sizes()
    some = np.flatnonzero(ok)
    got, held = entries.take(ids.take(some).values).values, want.take(some)
    wrong = np.repeat(np.arange(len(some)), held.sizes())[got != held.values]
    ok[some[wrong]] = False
    return ok


def _intervals(ids: Ragged, entries: Ragged, first: int) -> pa.Table:
    """unit, i, id, s, e of each token; unit counts from first, places are over all units."""
    size = entries.sizes()[ids.values]
    end = np.cumsum(size)
    return pa.table({"unit": np.repeat(np.arange(first, first + len(ids.start) - 1), ids.sizes()), "i": np.arange(len(end)), "id": ids.values, "s": end - size, "e": end})


def _units(a: Ragged, b: Ragged, coder: Encoders) -> tuple[Ragged, Ragged, np.ndarray]:
    """Tokens by unit, and where each part's units begin: a part, or if that is long, stretches of it between common ends."""
    ends = [np.cumsum(e.sizes()[x.values]) for x, e in ((a, coder.bytes_a), (b, coder.bytes_b))]
    upto = [0] if not len(ends[0]) else np.concatenate(([0], ends[0]))[a.start]
    size = np.diff(upto)
    if not (size > MOST_UNIT).any():
        return a, b, np.arange(len(a.start))
    common = np.intersect1d(*ends)
    cuts, n = [np.asarray(upto)], np.ones(len(size), np.int64)
    for k in np.flatnonzero(size > MOST_UNIT):
        own = common[np.searchsorted(common, upto[k], "right") : np.searchsorted(common, upto[k + 1])]
        own = own[np.unique(np.searchsorted(own, np.arange(upto[k] + MOST_UNIT, upto[k + 1], MOST_UNIT)).clip(max=max(len(own) - 1, 0)))] if len(own) else own
        cuts.append(own)
        n[k] += len(own)
    at = np.unique(np.concatenate(cuts))
    start = [np.searchsorted(e, at, "right") for e in ends]
    return Ragged(a.values, start[0]), Ragged(b.values, start[1]), np.concatenate(([0], np.cumsum(n)))


class _Aligner:
    def __init__(self, coder: Encoders):
        self.coder = coder
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.db.execute("CREATE TABLE unit_pairs (unit BIGINT, pair BIGINT, n BIGINT)")

    def units(self, a: Ragged, b: Ragged) -> tuple[list[bytes], np.ndarray]:
        """Text of the groups of each unit, with a semicolon after each group, and how many groups it has; links go into unit_pairs."""
        texts, n_groups = [], []
        sizes = np.cumsum(a.sizes() + b.sizes())
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + MOST_TOKENS, "right")))
            which = np.arange(lo, hi)
            self.db.register("a", _intervals(a.take(which), self.coder.bytes_a, lo))
            self.db.register("b", _intervals(b.take(which), self.coder.bytes_b, lo))
            self.db.execute(_ALIGN.format(span=SPAN))
            found = self.db.sql(_GROUPS).to_arrow_table().combine_chunks()
            unit, pieces = found["unit"].to_numpy(), found["piece"].combine_chunks().cast(pa.large_binary())
            ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
            data = memoryview(pieces.buffers()[2]) if len(pieces) else b""
            at = ends[np.searchsorted(unit, np.arange(lo, hi + 1))]
            texts += [bytes(data[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n_groups.append(np.bincount(unit - lo, found["ends"].to_numpy(), hi - lo).astype(np.int64))
            lo = hi
        for name in ("a", "b") if lo else ():
            self.db.unregister(name)
        return texts, np.concatenate([np.empty(0, np.int64), *n_groups])

    def batch(self, texts: list[str | None]) -> tuple[dict, list, list, tuple]:
        """Columns by document, then its pairs and how often it links each, then all pairs with how many documents hold them."""
        known: dict[str, int] = {}
        number = known.setdefault
        docs = Ragged.joined([Ragged.of([[number(p, len(known)) for p in self.coder.parts(t)] if t else []], np.int64) for t in texts], np.int64)
        parts = list(known)
        a, b = self.coder.ids_a(parts), self.coder.ids_b(parts)
        raw = [p.encode() for p in parts]
        whole = _whole(a, self.coder.bytes_a, raw) & _whole(b, self.coder.bytes_b, raw)
        owner = np.repeat(np.arange(len(texts)), docs.sizes())
        good = np.bincount(owner[~whole[docs.values]], minlength=len(texts)) == 0
        # only parts of documents that have tokens are aligned
        used = np.unique(docs.values[good[owner]])
        place = np.zeros(len(parts), np.int64)
        place[used] = np.arange(len(used))
        ua, ub, first = _units(a.take(used), b.take(used), self.coder)
        texts_of, n_groups = self.units(ua, ub)
        of_part = Ragged(np.arange(len(texts_of)), first)
        kept = docs.take(np.flatnonzero(good))
        held = of_part.take(place[kept.values])
        doc = np.repeat(np.repeat(np.flatnonzero(good), kept.sizes()), held.sizes())
        unit = held.values
        self.db.register("held", pa.table({"doc": doc, "unit": unit}))
        self.db.execute(_LINKS)
        links = self.db.sql("FROM links ORDER BY doc, pair").to_arrow_table().combine_chunks()
        total = self.db.sql("SELECT pair, count(*) AS n FROM links GROUP BY pair").to_arrow_table().combine_chunks()
        upto = np.searchsorted(links["doc"].to_numpy(), np.arange(len(texts) + 1))
        sums = lambda values: np.bincount(doc, values[unit], len(texts)).astype(np.int64)
        begins, digests = np.searchsorted(doc, np.arange(len(texts) + 1)), []
        for i, j in zip(begins[:-1], begins[1:], strict=True):
            digests.append(hashlib.sha256(b"".join(map(texts_of.__getitem__, unit[i:j].tolist()))[:-1]).hexdigest() if j > i else "")
        n_links = np.concatenate(([0], np.cumsum(links["n"].to_numpy())))[upto]
        columns = {"n_a": sums(ua.sizes()), "n_b": sums(ub.sizes()), "n_groups": sums(n_groups), "n_links": np.diff(n_links), "groups_sha256": digests}
        self.db.execute("DROP TABLE links; DELETE FROM unit_pairs")
        self.db.unregister("held")
        lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), links[c].combine_chunks()) for c in ("pair", "n")]
        return columns, lists, [total["pair"].to_numpy(), total["n"].to_numpy()], good


_COLUMNS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(batches: Iterator[pa.RecordBatch], files: tuple[bytes, bytes]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each batch with the partial counts of pairs, whose row_no is null."""
    aligner = _Aligner(encoders(*files))
    longs = pa.list_(pa.int64())
    for batch in batches:
        columns, lists, (pairs, counts), _ = aligner.batch(batch.column("text").to_pylist())
        names = ["row_no", "doc_id", *_COLUMNS, "groups_sha256", "pairs", "times"]
        yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("doc_id"), *(pa.array(columns[c], pa.int64()) for c in _COLUMNS), pa.array(columns["groups_sha256"], pa.string()), *lists], names)
        none = [pa.nulls(1, pa.int64()), pa.nulls(1, batch.column("doc_id").type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([pairs], longs), pa.array([counts], longs)], names)


def aligned(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; a row each.

    A: space+text by the byte-level vocabulary; B: text by the sentence-piece vocabulary, which adds the space. Groups lie between byte offsets where tokens of both end;
    a link is a pair of an A and a B token whose byte ranges overlap. The count of an id pair is the number of rows that hold it linked; n_best: links whose
    count is the highest that their A id has, ties included; count_sum: counts over all links. groups_sha256: SHA-256 of `a1,a2|b1;a3|b2,b3`.
    Texts that are null, empty, or that either side's joined bytes don't give back have no tokens: zeros and ''. Repeated rows and null
    ids are rows as any other; an empty table gives an empty result. Other columns don't matter.
    """
    files = vocabulary_files(tokenizers)
    small_batches(docs.sparkSession, BATCH_BYTES)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")
    schema = f"row_no bigint, doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
    found = durable(given.mapInArrow(lambda it: _aligned(it, files), schema), "aligned")
    each = lambda rows, first: rows.select(*first, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(*first, "x.pairs", "x.times")
    counts = durable(each(found.where("row_no is null"), []).groupBy("pairs").agg(F.sum("times").alias("docs")), "pair-counts")
    by_a = F.floor(F.col("pairs") / F.lit(SPAN))
    highest = counts.groupBy(by_a.alias("a")).agg(F.max("docs").alias("highest"))  # a row for each id of A's vocabulary at most
    known = counts.withColumn("a", by_a).join(F.broadcast(highest), "a").select("pairs", "docs", (F.col("docs") == F.col("highest")).alias("best"), F.col("docs").alias("rows"))
    met = joined_by_key(each(found.where("row_no is not null"), ["row_no"]), durable(known, "known-pairs"), "pairs", "rows")
    sums = met.groupBy("row_no").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    rows = found.where("row_no is not null").select("row_no", "doc_id", *_COLUMNS, "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row_no", "left").select("doc_id", *_COLUMNS, zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
