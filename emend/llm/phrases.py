"""Phrase collocation mining by pivot partitioning: fragments of text go to the rarest word of their n-grams and are mined there.

A first pass counts words. Words are ordered by count, and an n-gram belongs to the leftmost of its rarest words, its pivot. So each occurrence of a
frequent word gives one fragment: the words around it, as far as an n-gram may reach, cut before words that are rarer or infrequent
(on the left also before equal ones). Equal fragments of a task are one row with a count; cells, hashes of pivots, gather them.
A cell counts, level by level, only n-grams that hold the pivot of their fragment, and goes on only from frequent ones, so that every n-gram is
counted in one cell alone. Very common pivots are dealt further by the word after the pivot, or before it where the n-gram ends there,
which is again a part of the n-gram; nothing is summed up twice.

The order of words is read from a table of fixed size, by hash: words that share a place share a count there, the larger one. Any order gives the same result,
as an n-gram's owner depends on its words alone; a table that is full makes fragments longer, no count wrong.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, durable, joined_by_key, small_batches, table
from .shingles import U, mixed, word_hashes
from .tokenizers import Ragged

#: The signs that end a piece, and the blanks between words.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Places of the table of counts, as a power of two: 8 bytes each in a task.
TABLE_BITS = 21
#: Words of text for each cell, and bytes of fragments beyond which a cell gives counts of what it holds and goes on.
CELL_WORDS, MOST_HELD = 500_000, 48 << 20
#: A pivot is very common if it makes up more than this share of all words, or a cell's worth of them.
COMMON_SHARE = 1 / 1000
#: Bytes of a text that are looked at together, and of a batch.
CHUNK, BATCH_BYTES = 1 << 20, 8 << 20
#: Rows of one language that one task ranks.
MOST_RANKED = 100_000
_ONLY_RIGHT = 64

_kind = np.zeros(256, np.uint8)
_kind[list(BLANKS)] = 1
_kind[list(BREAKS)] = 2
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_NO_WORD = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
_BITS = 24


def _chunks(data: bytes, beside: int) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, from, to): stretches of about CHUNK bytes that end beside a word, with so many words around as beside says; own words begin from..to."""
    after = re.compile(rb"(?:[\x20\x09.,;:!?\x0a-\x0d]*[^\x20\x09.,;:!?\x0a-\x0d]+){0,%d}" % beside)
    before, at = b"", 0
    while at < len(data):
        end = _NO_WORD.search(data, min(at + CHUNK, len(data)))
        upto = end.start() if end else len(data)
        reach = after.match(data, upto).end() if beside else upto
        yield before + data[at:reach], len(before), len(before) + upto - at
        if beside:
            own = before + data[at:upto]
            words = [m.start() for m in re.finditer(rb"[^\x20\x09.,;:!?\x0a-\x0d]+", own[-4096:])]
            if len(words) > beside:
                before = own[len(own) - min(4096, len(own)) + words[-beside] :]
            else:
                words = [m.start() for m in re.finditer(rb"[^\x20\x09.,;:!?\x0a-\x0d]+", own)]
                before = own[words[max(len(words) - beside, 0)] :] if words else own[-1:]
        at = upto


def _words(data: bytes) -> tuple[Ragged, np.ndarray, np.ndarray]:
    """Words in lower case with a space after each, the piece that each is in, and where it starts."""
    letters = np.frombuffer(data + b"\n", np.uint8)
    kind = _kind[letters]
    edge = np.diff(np.concatenate(([0], (kind == 0).view(np.int8))))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2)[start]
    words = Ragged(_lower[letters], np.append(start, 0))
    size = end - start + 1
    upto = np.concatenate(([0], np.cumsum(size)))
    out = words.values[np.arange(int(upto[-1])) + np.repeat(start - upto[:-1], size)]
    out[upto[1:] - 1] = 0x20
    return Ragged(out, upto), piece, start


def _binary(values: np.ndarray, start: np.ndarray, kind=None) -> pa.Array:
    return pa.Array.from_buffers(kind or pa.binary(), len(start) - 1, [None, pa.py_buffer(np.ascontiguousarray(start, np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start[i]:end[i]], one after another, and where each begins."""
    size = end - start
    upto = np.concatenate(([0], np.cumsum(size)))
    return values[np.arange(int(upto[-1])) + np.repeat(start - upto[:-1], size)], upto


def _salt(lang: str) -> np.uint64:
    return U(zlib.crc32(lang.encode()) + 1)


def _hashes(words: Ragged, lang: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(word_hashes(words.values.tobytes())[0] + _salt(lang) * U(0x9E3779B97F4A7C15))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """All texts of each language, with a line break between."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
        if text:
            texts.setdefault(lang, []).append(text)
    for lang, own in texts.items():
        yield lang, b"\n".join(own)


def _some(ids: np.ndarray, k: int, rows: np.ndarray | None = None) -> np.ndarray:
    """For each of k ids a row that has it."""
    out = np.zeros(k, np.int64)
    out[ids] = np.arange(len(ids)) if rows is None else rows
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, place, n)."""
    for batch in batches:
        for lang, data in _by_lang(batch):
            parts = []
            for chunk, _, _ in _chunks(data, 0):
                words, _, _ = _words(chunk)
                parts.append(_binary(words.values, words.start))
            found = pa.concat_arrays(parts).value_counts()
            words, n = found.field("values"), found.field("counts")
            if not len(words):
                continue
            start = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
            values = np.frombuffer(words.buffers()[2], np.uint8)[start[0] : start[-1]]
            place = _hashes(Ragged(values, start - start[0]), lang) >> U(64 - TABLE_BITS)
            bare, upto = _spans(values, (start - start[0])[:-1].astype(np.int64), (start - start[0])[1:].astype(np.int64) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), _binary(bare, upto, pa.string()), pa.array(place.astype(np.int64)), pa.array(n.to_numpy(zero_copy_only=False), pa.int64())], ["lang", "word", "place", "n"])


def _reach(key: np.ndarray, piece: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before (rarer none, equal none) and after (rarer none) each frequent word an n-gram with this pivot may have."""
    left, right = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    before, after = key > 0, key > 0
    for d in range(1, min(longest, len(key))):
        same = piece[d:] == piece[:-d]
        before[d:] &= same & (key[:-d] > key[d:])
        before[:d] = False
        after[:-d] &= same & (key[d:] >= key[:-d])
        after[len(key) - d :] = False
        left += before
        right += after
    return left, right


class _Pivots:
    """The order of words and what follows from it; goes to all tasks."""

    def __init__(self, place: np.ndarray, n: np.ndarray, common: int, cells: int, longest: int):
        self.place, self.n, self.common, self.cells, self.longest = place, n, common, cells, longest

    def table(self) -> np.ndarray:
        out = np.zeros(1 << TABLE_BITS, np.int64)
        out[self.place] = self.n
        return out


def _fragments(batches: Iterator[pa.RecordBatch], pivots: _Pivots) -> Iterator[pa.RecordBatch]:
    """Rows (cell, lang, fragments, at, n): fragments end in a line break; the place of the pivot and the count of each."""
    count = pivots.table()
    for batch in batches:
        for lang, data in _by_lang(batch):
            parts, offsets, cells = [], [], []
            for chunk, lo, hi in _chunks(data, pivots.longest - 1):
                words, piece, start = _words(chunk)
                if len(start) < 2:
                    continue
                hashed = _hashes(words, lang)
                n = count[hashed >> U(64 - TABLE_BITS)]
                key = np.where(n > 0, (np.minimum(n, 1 << 38).astype(U) << U(_BITS)) | (hashed & U((1 << _BITS) - 1)), U(0))
                left, right = _reach(key, piece, pivots.longest)
                at = np.flatnonzero((left + right > 0) & (start >= lo) & (start < hi))
                own, far = mixed(key[at] + _salt(lang)), n[at] > pivots.common
                plain, after, before = at[~far], at[far & (right[at] > 0)], at[far & (left[at] > 0)]
                with np.errstate(over="ignore"):
                    cells += [own[~far], mixed(own[far & (right[at] > 0)] + hashed[after + 1]), mixed(own[far & (left[at] > 0)] ^ mixed(hashed[before - 1]))]
                offsets += [left[plain], left[after] + _ONLY_RIGHT, left[before]]
                first = np.concatenate((plain - left[plain], after - left[after], before - left[before]))
                last = np.concatenate((plain + right[plain], after + right[after], before))
                values, upto = _spans(words.values, words.start[first], words.start[last + 1])
                values[upto[1:] - 1] = 0x0A
                parts.append(_binary(values, upto))
            if not sum(map(len, parts)):
                continue
            coded = pa.concat_arrays(parts).dictionary_encode()
            index = coded.indices.to_numpy()
            own = _some(index, len(coded.dictionary))
            cell = (np.concatenate(cells)[own] % U(pivots.cells)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            held = coded.dictionary.take(pa.array(order))
            cell = cell[order]
            edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            start = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
            lists = lambda values: pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values[order]))  # noqa: B023, E731
            blobs = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(start[edge].copy()), held.buffers()[2]])
            n = np.bincount(index, minlength=len(held)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell[edge[:-1]], pa.int64()), pa.array([lang] * (len(edge) - 1), pa.string()), blobs, lists(np.concatenate(offsets)[own].astype(np.int8)), lists(n)], ["cell", "lang", "fragments", "at", "n"])


def _codes(values: pa.Array) -> tuple[np.ndarray, int]:
    """Numbers from 0 for distinct values, and how many there are."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


class _Cell:
    """The fragments of one cell and language."""

    def __init__(self, lang: str, longest: int, least: int):
        self.lang, self.longest, self.least = lang, longest, least
        self.held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.bytes, self.whole = 0, True

    def add(self, fragments: bytes, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = np.frombuffer(fragments, np.uint8)
        self.held.append((_binary(values, np.concatenate(([0], np.flatnonzero(values == 0x0A) + 1))), at, n))
        self.bytes += len(fragments) + 9 * len(n)
        if self.bytes > MOST_HELD:
            self.merge()
            if self.bytes > MOST_HELD // 2:  # counts of this cell come in several parts, so none is left out
                self.whole = False
                yield from self.mined()
                self.held, self.bytes = [], 0

    def merge(self) -> None:
        """Equal fragments become one."""
        coded = pa.concat_arrays([x[0] for x in self.held]).dictionary_encode()
        index, fragments = coded.indices.to_numpy(), coded.dictionary
        n = np.bincount(index, np.concatenate([x[2] for x in self.held]), len(fragments)).astype(np.int64)
        self.held = [(fragments, np.concatenate([x[1] for x in self.held])[_some(index, len(fragments))], n)]
        self.bytes = fragments.nbytes + 9 * len(n)

    def mined(self) -> Iterator[pa.RecordBatch]:
        """Rows (lang, phrase, words, n) of all n-grams with the pivot, if this is the whole cell: of the frequent ones."""
        if not self.held:
            return
        self.merge()
        fragments, at, weight = self.held[0]
        start = np.frombuffer(fragments.buffers()[1], np.int32)[fragments.offset : fragments.offset + len(fragments) + 1].astype(np.int64)
        values = np.frombuffer(fragments.buffers()[2], np.uint8)[start[0] : start[-1]]
        ends = np.flatnonzero((values == 0x20) | (values == 0x0A)) + 1
        begins = np.concatenate(([0], ends[:-1]))
        line = values[ends - 1] == 0x0A
        first = np.flatnonzero(np.concatenate(([True], line[:-1])))
        size = np.diff(np.append(first, len(ends)))
        bare, upto = _spans(values, begins, ends - 1)
        word, n_words = _codes(_binary(bare, upto))
        only_right = at >= _ONLY_RIGHT
        left = (at % _ONLY_RIGHT).astype(np.int64)
        pivot, right = first + left, size - 1 - left
        out: list[tuple[np.ndarray, np.ndarray, int, int]] = []

        def grown(rows: np.ndarray, ids: np.ndarray, other: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            """The n-grams of one word more that have i words before the pivot and j after; rows that can go on."""
            ids, k = _codes(pa.array(ids * n_words + word[other]))
            n = np.bincount(ids, weight[rows], k).astype(np.int64)
            kept = n >= self.least if self.whole else np.ones(k, bool)
            shown = np.flatnonzero(kept)
            out.append((_some(ids, k, rows)[shown], n[shown], i, j))
            go = kept[ids]
            return rows[go], ids[go]

        along = np.arange(len(size)), word[pivot]
        for j in range(self.longest):
            if j:
                go = right[along[0]] >= j
                rows = along[0][go]
                along = grown(rows, along[1][go], pivot[rows] + j, 0, j)
            rows, ids = along
            for i in range(1, self.longest - j):
                go = left[rows] >= i
                if not j:
                    go &= ~only_right[rows]
                if not go.any():
                    break
                rows, ids = grown(rows[go], ids[go], pivot[rows[go]] - i, i, j)
        for rows, n, i, j in out:
            if len(rows):
                text, upto = _spans(values, begins[pivot[rows] - i], ends[pivot[rows] + j] - 1)
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(rows), pa.string()), _binary(text, upto, pa.string()), pa.array(np.full(len(rows), i + j + 1)), pa.array(n)], ["lang", "phrase", "words", "n"])


def _mined(batches: Iterator[pa.RecordBatch], longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """Fragments, sorted by cell and language -> counted n-grams."""
    held, key = None, None
    for batch in batches:
        lists = [batch.column(c) for c in ("at", "n")]
        flat = [x.flatten().to_numpy() for x in lists]
        upto = np.concatenate(([0], np.cumsum(lists[0].value_lengths().to_numpy())))
        for i, (cell, lang, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "lang", "fragments")), strict=True)):
            if (cell, lang) != key:
                if held:
                    yield from held.mined()
                held, key = _Cell(lang, longest, least), (cell, lang)
            yield from held.add(blob, *(x[upto[i] : upto[i + 1]] for x in flat))
    if held:
        yield from held.mined()


def counts(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of up to `longest` words that occur `least` times in their language, and (lang, n) of all words."""
    spark = docs.sparkSession
    small_batches(spark, BATCH_BYTES)
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = given.mapInArrow(_word_counts, "lang string, word string, place bigint, n bigint").groupBy("lang", "word", "place").agg(F.sum("n").alias("n"))
    words = durable(words, "words")
    totals = durable(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    all_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = words.where(F.col("n") >= least)
    order = frequent.groupBy("place").agg(F.max("n").alias("n")).toArrow()  # 2 ** TABLE_BITS rows at most
    cells = max(all_words // CELL_WORDS, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    pivots = _Pivots(order["place"].to_numpy().astype(np.uint32), order["n"].to_numpy(), int(min(CELL_WORDS, all_words * COMMON_SHARE)), cells, longest)
    fragments = given.mapInArrow(lambda it: _fragments(it, pivots), "cell bigint, lang string, fragments binary, at array<tinyint>, n array<bigint>")
    fragments = fragments.repartition("cell").sortWithinPartitions("cell", "lang")
    mined = fragments.mapInArrow(lambda it: _mined(it, longest, least), "lang string, phrase string, words bigint, n bigint")
    found = mined.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return durable(found.union(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).cast("long").alias("words"), "n")), "phrases"), totals


def _met(rows: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the count of known (key, n) as `value`; frequent keys aren't gathered in a task."""
    one = known.join(rows.groupBy(key).agg(F.count("*").alias("rows")), key).select(key, F.col("n").alias(value), "rows")
    return joined_by_key(rows, durable(one, "met"), key, "rows")


def _scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, n, l, r, score of phrases of several words, at the cut with the lowest score."""
    known = found.select(F.struct("lang", "phrase").alias("part"), "n")
    many = _met(found.where("words > 1").withColumnRenamed("n", "a"), totals, "lang", "n")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1)))
    cuts = cuts.withColumn("one", F.expr("substring_index(phrase, ' ', k)")).withColumn("other", F.expr("substring_index(phrase, ' ', k - cast(words as int))"))
    cuts = durable(_met(cuts.withColumn("part", F.struct("lang", F.col("one").alias("phrase"))), known, "part", "l").drop("part", "one"), "cuts")
    cuts = _met(cuts.withColumn("part", F.struct("lang", F.col("other").alias("phrase"))), known, "part", "r").drop("part", "other")
    score = F.expr("(cast(1000 * a as decimal(38, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(38, 0)) * cast(r as decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "n", "cut.l", "cut.r", "cut.score")


def _first_ranks(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of each language by rank; languages with many rows are cut down in parts first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    while True:
        rows = durable(rows, "ranked")
        sizes = durable(rows.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
        largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if largest <= max(MOST_RANKED, 4 * most):
            return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
        parts = _met(rows.withColumnRenamed("n", "all_words"), sizes, "lang", "n").withColumn("part", F.pmod(F.xxhash64("phrase"), F.ceil(F.col("n") / max(MOST_RANKED // 2, 2 * most))))
        kept = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
        before, rows = rows, kept.drop("rank", "part", "n").withColumnRenamed("all_words", "n").select(*rows.columns)
        drop(sizes)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000) -> DataFrame:
    """docs (text, lang, ...) -> lang, rank, phrase, a, l, r, n, score: the strongest phrases of each language.

    A-Z count as a-z; texts are cut at `.,;:!?` and line breaks into pieces, these at blanks into words. Phrases have 2 to `longest` words and occur `least` times
    (a) inside pieces, overlaps included. A cut after the first words gives l and r, the counts of both parts, and the score floor(1000 a n / (l r)), n being
    all words of the language, in exact decimals; the lowest score counts, then the earliest cut. Phrases inside a longer one that occurs as often are left out. Of
    each language the first `most` rows by score, a, and phrase. A null language is `und`; null and empty texts, or texts of signs alone, have no words; repeated rows
    count each time; ids don't matter, nor do other columns. An empty table gives an empty result.
    """
    found, totals = counts(docs, least, longest)
    many = found.where("words > 1")
    longer = many.where("words > 2").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', cast(words as int) - 1)"), F.expr("substring_index(phrase, ' ', 1 - cast(words as int))"))).alias("phrase"), F.col("n").alias("a"))
    kept = _scored(found, totals).join(longer.distinct(), ["lang", "phrase", "a"], "left_anti")
    return _first_ranks(kept, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: All phrases of all pieces, counted at once: for tables that a single machine holds.
OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
phrases AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, range(1, 6) AS sizes(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k AS words, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, words, f AS a, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
parts AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[c.k + 1:], ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = b.lang AND x.words > len(string_split(b.phrase, ' ')) AND x.f >= b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
