"""The max-match score: of all edit sequences that turn a source into a hypothesis, the one that agrees best with the gold edits.

The sequences are paths of a lattice over both Levenshtein tables (substitution at cost 1 and at cost 2), with arcs that span several
steps as long as they pass over few unchanged words. Sentences and annotators are scored in parallel; only the choice of the
annotator where there are several looks at the running totals of the corpus. Bounds on these totals settle most choices in parallel, whatever came before;
what stays open is replayed in order, a slice at a time.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordering import numbered, running_sums

Cell = tuple[int, int]


@dataclass(frozen=True)
class Gold:
    start: int
    end: int
    original: str
    corrections: tuple[str, ...]


@dataclass(frozen=True)
class Arc:
    """From one cell to another: the source span, its words, the hypothesis' words, steps, and whether nothing changes."""

    tail: Cell
    head: Cell
    original: str
    correction: str
    steps: int
    idle: bool

    @property
    def span(self) -> tuple[int, int]:
        return self.tail[0], self.head[0]


#: Lattices, and counts, that a task keeps: annotators share the lattice of their sentence, and sentences come back.
KEPT_LATTICES, KEPT_COUNTS = 500, 20_000
#: Cells up to which the whole table of distances is made in plain Python.
FEW_CELLS = 2_000
#: Words from and up to which changes that stand apart are counted without a lattice; shorter sentences have small ones, and in longer ones 0.001 a change adds up to steps.
PLAIN_FROM, PLAIN_UPTO = 4, 999


def _costs(source: Sequence[str], words: Sequence[str], change: int):
    """cost(i, j) of turning the first i words into the first j, a change costing `change`; exact wherever a cheapest alignment passes, else too large at most.

    Longer tables are made a row at a time, in a band around the diagonal: a path that leaves a band of width t costs more than t. The band is
    doubled until the whole costs no more than it is wide.
    """
    n, m = len(source), len(words)
    if n * m <= FEW_CELLS:
        cost = [list(range(m + 1))]
        for i, a in enumerate(source, 1):
            above, left = cost[-1], i
            row, corner = [i], i - 1
            for w, up in zip(words, above[1:], strict=True):
                own = corner if w == a else corner + change
                if up < own:
                    own = min(own, up + 1)
                left = own if own <= left else left + 1
                row.append(left)
                corner = up
            cost.append(row)
        return lambda i, j: cost[i][j]
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in side]) for side in (source, words))
    band = max(16, 2 * abs(n - m))
    while True:
        band = min(band, n + m)
        top, place = n + m + 1, np.arange(2 * band + 1)
        padded = np.concatenate((np.full(band + 1, -1), b, np.full(n + band + 1, -1)))  # b[j] is padded[j + band + 1]
        rows = np.empty((n + 1, 2 * band + 1), np.int16 if top < 30_000 else np.int32)
        row = np.where((place >= band) & (place - band <= m), place - band, top)
        rows[0] = row
        for i in range(1, n + 1):  # place k of row i is column i + k - band
            new = row + np.where(padded[i + 0 : i + 2 * band + 1] == a[i - 1], 0, change)
            new[:-1] = np.minimum(new[:-1], row[1:] + 1)
            low, high = band - i, m - i + band
            if low >= 0:
                new[:low], new[low] = top, i
            new[high + 1 :] = top
            row = np.minimum(np.minimum.accumulate(new - place) + place, top)
            row[high + 1 :] = top
            if low > 0:
                row[:low] = top
            rows[i] = row
        if rows[n, m - n + band] <= band or band == n + m:
            return lambda i, j: int(rows[i, j - i + band]) if 0 <= j - i + band <= 2 * band else top
        band *= 2


def _steps(source: Sequence[str], words: Sequence[str], change: int) -> set[tuple[Cell, Cell]]:
    """Steps of all cheapest alignments, a change of a word costing `change`."""
    n, m = len(source), len(words)
    cost = _costs(source, words, change)
    found: set[tuple[Cell, Cell]] = set()
    todo, seen = [(n, m)], {(n, m)}
    while todo:
        i, j = todo.pop()
        before, own = [], cost(i, j)
        if i and j and own == cost(i - 1, j - 1) + (0 if source[i - 1] == words[j - 1] else change):
            before.append((i - 1, j - 1))
        if i and own == cost(i - 1, j) + 1:
            before.append((i - 1, j))
        if j and own == cost(i, j - 1) + 1:
            before.append((i, j - 1))
        for b in before:
            found.add((b, (i, j)))
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return found


def lattice(source: Sequence[str], words: Sequence[str], most_unchanged: int = 2) -> list[Arc]:
    """All arcs, in the order of their cells."""
    if source == words:  # one alignment costs nothing
        return [Arc((i, i), (i + 1, i + 1), w, w, 1, True) for i, w in enumerate(source)]
    steps = _steps(source, words, 1) | _steps(source, words, 2)
    after: dict[Cell, list[Cell]] = {}
    for a, b in steps:
        after.setdefault(a, []).append(b)
    idle = lambda a, b: b[0] - a[0] == 1 and b[1] - a[1] == 1 and source[a[0]] == words[a[1]]
    arcs = []
    for start in sorted(after):
        reached = {(start, 0, True): 0}  # (cell, unchanged words, nothing changed) -> steps
        todo = [(start, 0, True)]
        for state in todo:
            cell, unchanged, same = state
            for b in after.get(cell, ()):
                kept = idle(cell, b)
                new = (b, unchanged + kept, same and kept)
                if new[1] <= most_unchanged and new not in reached:
                    reached[new] = reached[state] + 1
                    todo.append(new)
        best: dict[Cell, tuple[int, bool]] = {}
        for (cell, _, same), n in reached.items():
            if cell != start and (n == 1 or not same):
                best[cell] = min(best.get(cell, (n, same)), (n, same))
        if idle_step := [b for b in after[start] if idle(start, b)]:
            best[idle_step[0]] = (1, True)
        arcs += [Arc(start, end, " ".join(source[start[0] : end[0]]), " ".join(words[start[1] : end[1]]), n, same) for end, (n, same) in sorted(best.items())]
    return arcs


def token_distance(source: Sequence[str], words: Sequence[str], change: int = 2) -> int:
    """Levenshtein distance of token lists."""
    row = list(range(len(words) + 1))
    for i, x in enumerate(source, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(words, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (0 if x == y else change))
    return row[-1]


def shrunk(start: int, end: int, original: str, correction: str) -> tuple[int, int, str, str]:
    """An edit without the words that both sides begin or end with."""
    a, b = original.split(), correction.split()
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
    return start + head, end - tail, " ".join(a[: len(a) - tail]), " ".join(b[: len(b) - tail])


def matches(arc: Arc, gold: Gold) -> bool:
    return arc.span == (gold.start, gold.end) and arc.original == gold.original and arc.correction in gold.corrections


def best_edits(arcs: list[Arc], gold: Sequence[Gold]) -> list[Arc]:
    """The changing arcs of the path with most gold edits, then fewest steps and changes."""
    weight = {a: a.steps + (0 if a.idle else 0.001) for a in arcs}
    by_span: dict[tuple[int, int], list[Gold]] = {}
    for g in gold:
        by_span.setdefault((g.start, g.end), []).append(g)
    used: dict[tuple[int, int], int] = {}
    for a in arcs:
        own = by_span.get(a.span, [])
        first = used.get(a.span, 0) if a.span[0] == a.span[1] else 0  # insertions at one place are matched in order, once
        hit = next((n for n in range(first, len(own)) if matches(a, own[n])), None)
        if hit is not None:
            weight[a] = -len(arcs) - 1
            if a.span[0] == a.span[1]:
                used[a.span] = hit + 1
    reach: dict[Cell, tuple[float, Arc | None]] = {(0, 0): (0, None)}
    for a in arcs:  # cells ascend along every path
        if a.tail in reach and (total := reach[a.tail][0] + weight[a]) < reach.get(a.head, (float("inf"), None))[0]:
            reach[a.head] = (total, a)
    out, at = [], max((a.head for a in arcs), default=(0, 0))
    while (a := reach[at][1]) is not None:
        if not a.idle:
            out.append(a)
        at = a.tail
    return out[::-1]


def agreed(edits: Sequence[Arc], gold: Sequence[Gold]) -> int:
    """Edits that meet a gold edit, both read in order."""
    n = at = 0
    for a in edits:
        hit = next((i for i in range(at, len(gold)) if matches(a, gold[i])), None)
        if hit is not None:
            n, at = n + 1, hit + 1
    return n


def counts(source: str, hypothesis: str, gold: Sequence[Gold], most_unchanged: int = 2, ignore_case: bool = False) -> tuple[int, int, int]:
    """(correct, proposed, gold) of one sentence and annotator."""
    return counted(lattice(source.split(), hypothesis.split(), most_unchanged), gold, ignore_case)


def counted(arcs: list[Arc], gold: Sequence[Gold], ignore_case: bool = False) -> tuple[int, int, int]:
    """counts() by a lattice that is there."""
    edits = best_edits(arcs, gold)
    if ignore_case:
        edits = [a for a in edits if "".join(a.original.split()).lower() != "".join(a.correction.split()).lower()]
    return agreed(edits, gold), len(edits), len(gold)


def plain_changes(source: Sequence[str], words: Sequence[str], most_unchanged: int = 2) -> list[int] | None:
    """The places of changed words if no cheapest alignment does anything else than change each of them where it stands, and no arc has two of them; None if that isn't known.

    New words that the source lacks are each inserted or put in place of a word, so at cost 1 a change the diagonal alone is cheapest. At cost 2 all other words are
    matched, and a word that differs from both its neighbours leaves them no other place. So all cheapest alignments meet on the diagonal outside the changes.
    """
    n = len(source)
    if n != len(words):
        return None
    at = [i for i, (a, b) in enumerate(zip(source, words, strict=True)) if a != b]
    if not at:
        return at
    if not PLAIN_FROM <= n <= PLAIN_UPTO:
        return None
    known, last = set(source), -n - most_unchanged
    for p in at:
        own = source[p]
        if p - last < most_unchanged + 2 or words[p] in known or (p and source[p - 1] == own) or (p + 1 < n and source[p + 1] == own):
            return None
        last = p
    return at


def plain_counts(source: Sequence[str], words: Sequence[str], at: list[int], gold: Sequence[tuple[int, int, str, Sequence[str]]], most_unchanged: int = 2, ignore_case: bool = False) -> tuple[int, int, int] | None:
    """counts() of plain_changes(), if each gold edit (start, end, original, corrections) is one of a changed word alone or out of reach of all arcs with a change; else None."""
    kept = [source[p].lower() != words[p].lower() for p in at] if ignore_case else None
    correct, last, met = 0, -1, set()
    for start, end, original, corrections in gold if at else ():
        if not 0 <= start <= end:  # no arc is there
            continue
        k = bisect(at, start)
        for i in range(max(k - 1, 0), min(k + 1, len(at))):
            p = at[i]
            if p - most_unchanged <= start and end <= p + 1 + most_unchanged:
                if start != p or end != p + 1 or p in met or "" in corrections:
                    return None
                met.add(p)
                if original == source[p] and words[p] in corrections and (kept is None or kept[i]):
                    if p < last:
                        return None
                    correct, last = correct + 1, p
    return correct, len(at) if kept is None else sum(kept), len(gold)


def f_score(correct: float, proposed: float, gold: float, beta: float = 0.5) -> float:
    bottom = beta * beta * gold + proposed
    return (1 + beta * beta) * correct / bottom if bottom else float(correct == 0)


# --- columns and DataFrames ---------------------------------------------------


def precision(correct: Column, proposed: Column) -> Column:
    return F.coalesce(F.try_divide(correct.cast("double"), proposed.cast("double")), F.lit(1.0))


def recall(correct: Column, gold: Column) -> Column:
    return F.coalesce(F.try_divide(correct.cast("double"), gold.cast("double")), F.lit(1.0))


def f_from_pr(p: Column, r: Column, beta: float = 0.5) -> Column:
    """Of a corpus: 0 where precision and recall are 0."""
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * p * r, b * p + r), F.lit(0.0))


def f_from_counts(correct: Column, proposed: Column, gold: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * correct.cast("double"), b * gold + proposed), F.when(correct == 0, 1.0).otherwise(0.0))


def sentence_counts(rows: DataFrame, most_unchanged: int = 2, ignore_case: bool = False) -> DataFrame:
    """rows (sent_idx, source, hypothesis, annotator, edits array<struct<s,e,orig,corr>>) -> sent_idx, annotator, correct, proposed, gold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arcs = lru_cache(KEPT_LATTICES)(lambda s, h: lattice(s.split(), h.split(), most_unchanged))
        own = lru_cache(KEPT_COUNTS)(lambda s, h, gold: counted(arcs(s, h), gold, ignore_case))
        sides = lru_cache(1)(lambda s, h: (a := s.split(), b := h.split(), plain_changes(a, b, most_unchanged)))  # annotators of a sentence follow each other

        def one(s: str, h: str, edits: list[dict]) -> tuple[int, int, int]:
            a, b, at = sides(s, h)
            found = None if at is None else plain_counts(a, b, at, [(e["s"], e["e"], e["orig"], e["corr"]) for e in edits] if at else edits, most_unchanged, ignore_case)
            return own(s, h, tuple(Gold(e["s"], e["e"], e["orig"], tuple(e["corr"])) for e in edits)) if found is None else found

        for df in batches:
            made = [one(s, h, g) for s, h, g in zip(df["source"], df["hypothesis"], df["edits"], strict=True)]
            yield pd.DataFrame({"sent_idx": df["sent_idx"], "annotator": df["annotator"]}).assign(**{c: [m[i] for m in made] for i, c in enumerate(("correct", "proposed", "gold"))})

    return rows.select("sent_idx", "source", "hypothesis", "annotator", "edits").mapInPandas(run, "sent_idx bigint, annotator int, correct bigint, proposed bigint, gold bigint")


#: Sentences with an open choice that one task replays, and rounds of bounds before each replay.
REPLAYED, ROUNDS = 100_000, 3
_FIELDS = ("correct", "proposed", "gold")
_CHOICE = "sent_idx bigint, annotator int, correct bigint, proposed bigint, gold bigint"


def _settled(options: Column, low: dict[str, Column], high: dict[str, Column], beta: float) -> Column:
    """The option that has the highest F whatever the totals before are, between low and high; null if none is known to.

    With C correct and D = beta^2 gold + proposed before, option i beats j if C (d_j - d_i) + D (c_i - c_j) + c_i d_j - c_j d_i > 0. This is linear in C and D, so
    it holds everywhere if it holds at the corners; what comes close to 0 is left open, as F is compared as a rounded number.
    """
    c = lambda o: o["correct"].cast("double")
    d = lambda o: beta * beta * o["gold"] + o["proposed"]
    c_low, c_high = c(low), c(high)
    d_low, d_high = d(low), d(high)

    def beats(i: Column, j: Column) -> Column:
        by_c, by_d = d(j) - d(i), c(i) - c(j)
        least = by_c * F.when(by_c >= 0, c_low).otherwise(c_high) + by_d * F.when(by_d >= 0, d_low).otherwise(d_high) + c(i) * d(j) - c(j) * d(i)
        rounding = 1e-12 * (c_high + F.greatest(c(i), c(j)) + 1) * (d_high + F.greatest(d(i), d(j)) + 1)
        same = (c(i) == c(j)) & (i["proposed"] == j["proposed"]) & (i["gold"] == j["gold"])
        return (same & (i["annotator"] < j["annotator"])) | (~same & (d_low + F.least(d(i), d(j)) > 0) & (least > rounding))

    return F.get(F.filter(options, lambda i: F.forall(options, lambda j: (i["annotator"] == j["annotator"]) | beats(i, j))), F.lit(0))


def _replay(batches: Iterator[pd.DataFrame], beta: float) -> Iterator[pd.DataFrame]:
    """Open choices (sent_idx, options, and the sums of settled ones before) in order -> the choices."""
    total = (0, 0, 0)
    for df in batches:
        out = []
        for sent, options, *others in df[["sent_idx", "options", *(f"{f}_before" for f in _FIELDS)]].itertuples(index=False):
            sums = [tuple(t + b + o[f] for t, b, f in zip(total, others, _FIELDS, strict=True)) for o in options]
            at = max(range(len(options)), key=lambda i: (f_score(*sums[i], beta), sums[i][0], -(sums[i][1] + beta * beta * sums[i][2]), -i))
            total = tuple(t + options[at][f] for t, f in zip(total, _FIELDS, strict=True))
            out.append((sent, *(options[at][f] for f in ("annotator", *_FIELDS))))
        yield pd.DataFrame(out, columns=["sent_idx", "annotator", *_FIELDS])


def chosen(stats: DataFrame, beta: float = 0.5, running: bool = True) -> DataFrame:
    """One annotator for each sentence: sent_idx, annotator, correct, proposed, gold.

    running: the one that makes the corpus' F highest so far (ties: more correct, then fewer proposed and gold, then the first annotator), sentences in order.
    Every sentence bounds what it may add to the totals, and running sums of the bounds settle each choice that is the same for all totals within them;
    settled choices narrow the bounds of later ones. The first REPLAYED choices that stay open are then made one after the other, and
    so on until none is open. Otherwise the one of the sentence's own highest F, in parallel.
    """
    if not running:
        own = f_from_counts(F.col("correct"), F.col("proposed"), F.col("gold"), beta)
        order = Window.partitionBy("sent_idx").orderBy(own.desc(), F.desc("correct"), F.col("proposed") + beta * beta * F.col("gold"), "annotator")
        return stats.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")

    option = F.struct(F.col("annotator").cast("int").alias("annotator"), *(F.col(f).cast("bigint").alias(f) for f in _FIELDS))
    rows = stats.groupBy("sent_idx").agg(F.array_sort(F.collect_list(option)).alias("options"))  # a few annotators each
    rows = stored(rows.withColumn("choice", F.when(F.size("options") == 1, F.get("options", F.lit(0)))), "m2")
    still, turn = rows.where("choice is null").count(), 0
    while still:
        bound = lambda f, pick: F.coalesce(F.col(f"choice.{f}"), pick(F.transform("options", lambda o: o[f])))
        known = {f"{f}_before": F.coalesce(F.col(f"choice.{f}"), F.lit(0)) for f in _FIELDS}
        ends = {f"{f}_{side}": bound(f, pick) for f in _FIELDS for side, pick in (("low", F.array_min), ("high", F.array_max))}
        if turn < ROUNDS:
            sums = running_sums(rows, ends, ["sent_idx"]).withColumns({n: F.col(n) - v for n, v in ends.items()})  # before the sentence
            low, high = ({f: F.col(f"{f}_{side}") for f in _FIELDS} for side in ("low", "high"))
            rows = stored(sums.withColumn("choice", F.coalesce("choice", _settled(F.col("options"), low, high, beta))).select("sent_idx", "options", "choice"), "m2")
        else:
            sums = running_sums(rows, known, ["sent_idx"]).where("choice is null")
            first = numbered(sums, ["sent_idx"], "place").where(F.col("place") < REPLAYED).drop("place", "choice")
            made = first.repartition(1).sortWithinPartitions("sent_idx").mapInPandas(lambda it: _replay(it, beta), _CHOICE)  # REPLAYED rows at most
            made = made.select("sent_idx", F.struct("annotator", *_FIELDS).alias("made"))
            rows = stored(rows.join(made, "sent_idx", "left").select("sent_idx", "options", F.coalesce("choice", "made").alias("choice")), "m2")
        left = rows.where("choice is null").count()
        turn, still = (turn + 1 if left and turn < ROUNDS and left < still else ROUNDS if turn < ROUNDS else 0), left
    return rows.select("sent_idx", "choice.*")


def corpus_score(rows: DataFrame, beta: float = 0.5, most_unchanged: int = 2, running: bool = True, ignore_case: bool = False) -> DataFrame:
    """One row: correct, proposed, gold, precision, recall, f."""
    total = chosen(sentence_counts(rows, most_unchanged, ignore_case), beta, running).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("correct", "proposed", "gold")))
    total = total.withColumn("precision", precision(F.col("correct"), F.col("proposed"))).withColumn("recall", recall(F.col("correct"), F.col("gold")))
    return total.withColumn("f", f_from_pr(F.col("precision"), F.col("recall"), beta))


def edit_rows(pairs: DataFrame, most_unchanged: int = 0) -> DataFrame:
    """pairs (sent_idx, source, target) with `edits` (s, e, correction): the shortest edits that turn one into the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            made = [[{"s": a.span[0], "e": a.span[1], "correction": a.correction} for a in best_edits(lattice(s.split(), t.split(), most_unchanged), [])] for s, t in zip(df["source"], df["target"], strict=True)]
            yield df.assign(edits=pd.Series(made, index=df.index, dtype=object))

    return pairs.select("sent_idx", "source", "target").mapInPandas(run, "sent_idx bigint, source string, target string, edits array<struct<s:int,e:int,correction:string>>")


def m2_text(rows: DataFrame, annotator: int = 0) -> DataFrame:
    """edit_rows() as blocks of the M2 format: sent_idx, value."""
    edit = lambda x: F.concat(F.lit("A "), x["s"].cast("string"), F.lit(" "), x["e"].cast("string"), F.lit("|||UNK|||"), x["correction"], F.lit(f"|||REQUIRED|||-NONE-|||{annotator}"))
    return rows.select("sent_idx", F.concat_ws("\n", F.concat(F.lit("S "), "source"), F.when(F.size("edits") > 0, F.array_join(F.transform("edits", edit), "\n")), F.lit("")).alias("value"))
