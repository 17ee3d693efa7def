"""Edit tags of sentence pairs: alignment, decoding, error sites, pairs of prefixes.

Alignment and decoding are dynamic programs over short token lists and run on Arrow batches; everything around them is relational.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import tags as T
from ..functions.text import blank_tokens, prefix

Item = tuple[str, list[str]]
ITEMS = "array<struct<token:string,tags:array<string>>>"
SITES = "array<struct<side:string,bucket:string,src_pos:int,tgt_pos:int,diff:string>>"


#: Tokens times words of a changed block up to which its spans are priced one by one; either way gives the same spans.
FEW_CELLS = 8
#: Starts of spans held at once while those of a large block are traced back; those of a larger one are made again, part by part.
MOST_STARTS = 1 << 24


@lru_cache(1 << 16)
def letters_apart(a: str, b: str) -> int:
    """Character Levenshtein distance."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def spans(tokens: Sequence[str], words: Sequence[str], verbs: T.Verbs | None = None) -> list[tuple[int, int]]:
    """For each token the span of words it becomes, so that the spans cover all words in order at the least cost.

    A span costs nothing if one tag makes it of the token, else the letters that differ. Of equal costs the earlier start wins.
    """
    if len(tokens) * len(words) > FEW_CELLS:
        return _spans_by_letters(tokens, words, verbs)

    @lru_cache(None)
    def cost(i: int, j: int, k: int) -> int:
        own = words[j:k]
        return 0 if T.transform(tokens[i], own, verbs) else letters_apart(tokens[i], "   ".join(own))

    best: list[dict[int, tuple[int, int]]] = [{0: (0, 0)}]  # by end of the span: least cost so far, and the span's start
    for i in range(len(tokens)):
        row: dict[int, tuple[int, int]] = {}
        for j, (so_far, _) in sorted(best[-1].items()):
            for k in range(j, len(words) + 1):
                total = so_far + cost(i, j, k)
                if k not in row or total < row[k][0]:
                    row[k] = (total, j)
        best.append(row)
    out, end = [], len(words)
    for row in reversed(best[1:]):
        start = row[end][1]
        out.append((start, end))
        end = start
    return out[::-1]


def _spans_by_letters(tokens: Sequence[str], words: Sequence[str], verbs: T.Verbs | None) -> list[tuple[int, int]]:
    """spans() in time of the letters of either side multiplied: all spans of a token are priced in one pass over the letters of the words.

    A number cost * unit + start holds the least cost of the ends so far and, of equal ones, the earliest start.
    """
    text, unit = "   ".join(words), len(words) + 1
    far = len(text) + sum(map(len, tokens)) + 1  # more than any cost
    kind = np.int32 if 4 * far * unit < 1 << 31 else np.int64
    ends = np.cumsum([len(w) + 3 for w in words]) - 3
    starts = ends - [len(w) for w in words]
    letters = np.array([ord(c) for c in text])
    ramp, number = np.arange(len(text) + 1, dtype=kind) * kind(unit), np.arange(unit, dtype=kind)
    differs = {c: (letters != ord(c)).astype(kind) * kind(unit) for c in {c for t in tokens for c in t}}
    places: dict[str, list[int]] = {}
    for j, w in enumerate(words):
        places.setdefault(w, []).append(j)
    cases: dict[str, list[str]] = {}
    for w in places:
        cases.setdefault(w.lower(), []).append(w)

    @lru_cache(None)
    def free(token: str) -> list[tuple[int, np.ndarray]]:
        """(words, starts) of the spans that one tag makes of the token."""
        found = [(0, number)] if T.transform(token, [], verbs) else []
        likely = {*cases.get(token.lower(), ()), token + "s", token[:-1], *(w for w in places if verbs and (token, w) in verbs)}
        found += [(1, np.array(places[w])) for w in likely if w in places and T.transform(token, [w], verbs)]
        if (n := len(parts := token.split("-"))) > 1:
            found += [(n, np.array([j])) for j in places.get(parts[0], ()) if list(words[j : j + n]) == parts]
        return found

    def after(token: str, costs: np.ndarray) -> np.ndarray:
        begun = costs * kind(unit) + number
        row = np.full(len(text) + 1, 2 * far * unit, dtype=kind)
        row[starts] = begun[:-1]
        row = np.minimum.accumulate(row - ramp) + ramp
        for c in token:
            step = row + kind(unit)
            np.minimum(step[1:], row[:-1] + differs[c], out=step[1:])
            step -= ramp
            np.minimum.accumulate(step, out=row)
            row += ramp
        best = begun + kind(unit * len(token))
        np.minimum(best[1:], row[ends], out=best[1:])
        for n, at in free(token):
            best[at + n] = np.minimum(best[at + n], begun[at])
        return best

    part = max(1, MOST_STARTS // unit)
    costs = np.full(unit, far, dtype=kind)
    costs[0] = 0
    before, held = [], []  # costs before each part; starts of the last part's spans
    for i, token in enumerate(tokens):
        if i % part == 0:
            before.append(costs)
            held = []
        best = after(token, costs)
        costs = best // kind(unit)
        held.append((best % kind(unit)).astype(np.int32))
    out, end = [], len(words)
    for i in reversed(range(len(tokens))):
        if not held:
            costs = before[i // part]
            for token in tokens[i - i % part : i + 1]:
                best = after(token, costs)
                costs = best // kind(unit)
                held.append((best % kind(unit)).astype(np.int32))
        start = int(held.pop()[end])
        out.append((start, end))
        end = start
    return out[::-1]


def _token_tags(token: str, words: Sequence[str], verbs: T.Verbs | None) -> tuple[list[str], list[str]]:
    """(tags for the token before, tags for this token) that turn the token into the words."""
    if not words:
        return [], [T.DELETE]
    for n in range(2, len(words) + 1):
        if tag := T.transform(token, words[:n], verbs):
            return [], [tag, *(T.APPEND + w for w in words[n:])]
    found = [T.transform(token, [w], verbs) for w in words]
    costs = [0 if f else letters_apart(token, w) for f, w in zip(found, words, strict=True)]
    at = costs.index(min(costs))
    own = found[at] or T.REPLACE + words[at]
    return [T.APPEND + w for w in words[:at]], [own, *(T.APPEND + w for w in words[at + 1 :])]


def align(source: str, target: str, verbs: T.Verbs | None = None) -> list[Item] | None:
    """Tags that turn the source into the target, the start token first; None if a text holds a mark of the file format."""
    if any(m in s for m in (T.LABEL_MARK, T.TAG_MARK) for s in (source, target)):
        return None
    tokens, words = source.split(), target.split()
    tags: list[list[str]] = [[] for _ in range(len(tokens) + 1)]  # of the start token, then of each token
    for kind, i, to, j, end in SequenceMatcher(None, tokens, words).get_opcodes():
        if kind == "delete":
            for n in range(i, to):
                tags[n + 1].append(T.DELETE)
        elif kind == "insert":
            tags[i] += [T.APPEND + w for w in words[j:end]]
        elif kind == "replace":
            own, new = tokens[i:to], words[j:end]
            if joined := T.merge(own, new):
                for n in range(i, to - 1 if joined != T.MERGE_SWAP else i + 1):
                    tags[n + 1].append(joined)
                continue
            for n, (a, b) in enumerate(spans(own, new, verbs)):
                before, at = _token_tags(own[n], new[a:b], verbs)
                tags[i + n] += before
                tags[i + n + 1] += at
    return [(t, g or [T.KEEP]) for t, g in zip([T.START, *tokens], tags, strict=True)]


def decode(items: Sequence[Item], forms: T.Verbs | None = None) -> str:
    """The target that tags make of a source. Each tag acts on the last token that stands, merges at the end."""
    out: list[str] = []
    marks: dict[int, str] = {}  # merge tags by the number of tokens before them
    for n, (token, own) in enumerate(items):
        if n:
            out.append(token)
        for tag in own:
            if tag.startswith(T.APPEND):
                out.append(tag[len(T.APPEND) :])
            elif tag.startswith("$MERGE_"):
                marks[len(out)] = tag
            elif not out:
                continue
            elif tag == T.DELETE:
                out.pop()
            elif tag.startswith(T.REPLACE):
                out[-1] = tag[len(T.REPLACE) :]
            elif tag.startswith("$TRANSFORM"):
                out[-1] = T.applied(out[-1], tag, forms)
    for at, tag in marks.items():
        if tag == T.MERGE_SWAP and 0 < at < len(out):
            out[at - 1], out[at] = out[at], out[at - 1]
    text = ""
    for n, token in enumerate(out):
        glue = {T.MERGE_SPACE: "", T.MERGE_HYPHEN: "-"}.get(marks.get(n, ""), " ")
        text += (glue if n else "") + token
    return " ".join(text.split())


class _Walk:
    """Positions in the target while tags of one side are read, token by token."""

    def __init__(self, target: str, variant: str, side: str):
        self.at, self.appended, self.length = -1, False, len(target.strip().split(" "))
        self.variant, self.side = variant, side

    def read(self, token: str, edits: list[str], following: str) -> tuple[list[tuple[int, str]], int | None, int | None]:
        """(changed positions with their differences, position of a kept token, position before an insertion)."""
        first, changed, kept, before = edits[0], [], None, None
        if first == T.KEEP:
            if self.appended:
                changed.append((self.at, f"{token} -> ADD_SUF {token}"))
            else:
                kept = self.at
            self.appended = False
            self.at += 1
        else:
            self.appended = False
            if first.startswith(T.DELETE):
                changed.append((self.at - (self.at == self.length), f"{token} -> "))
            elif "$APPEND" in first:
                before = self.at
                changed.append((self.at + 1, f"{token} -> {token} {first.replace(T.APPEND, '')}"))
                self.at += 2
                self.appended = True
            elif "$MERGE" in first:
                changed.append((self.at, f"{token} {following} -> {token}{following}"))
            else:
                changed.append((self.at, f"{token} -> {first.replace(T.REPLACE, '')}"))
                self.at += 1
                if first == T.SPLIT:
                    parts = token.split("-")
                    diff = f"{token} -> {' '.join(parts)}"
                    if self.variant == "build":
                        changed += [(self.at + n, diff) for n in range(len(parts) - 1)]
                        self.at += len(parts) - 1
                    else:
                        skipped = max(0, len(parts) - (1 if self.side == "gold" else 2))
                        changed.append((self.at + skipped, diff))
                        self.at += skipped + 1
        for extra in edits[1:]:
            changed.append((self.at, f"{changed[-1][1] if changed else token + ' -> ' + token} {extra.replace(T.APPEND, '')}"))
            self.at += 1
            self.appended = True
        return changed, kept, before


def sites(gold: Sequence[Item], pred: Sequence[Item], target: str, pred_target: str, variant: str = "build") -> list[tuple[str, str, int, int, str | None]]:
    """(side, bucket, src_pos, tgt_pos, diff) of every token: gold pos and neg, predicted tp, tpf, tn, fp and fn.

    variant (build or retrieve) says how a split at hyphens moves the target position. Each difference goes with its own site.
    """
    if variant not in ("build", "retrieve"):
        raise ValueError(f"variant {variant}")
    if [t for t, _ in gold] != [t for t, _ in pred]:
        raise ValueError("gold and predicted tags are of different sentences")
    out: list[tuple[str, str, int, int, str | None]] = []
    g, p = _Walk(target, variant, "gold"), _Walk(pred_target, variant, "pred")
    for n, ((token, own), (_, guess)) in enumerate(zip(gold, pred, strict=True)):
        following = gold[n + 1][0] if n + 1 < len(gold) else ""
        changed, kept, _ = g.read(token, own, following)
        if kept is not None:
            out.append(("gold", "neg", n - 1, kept, None))
        out += [("gold", "pos", n - 1, at, diff) for at, diff in changed]
        changed, kept, _ = p.read(token, guess, following)
        if kept is not None:
            out.append(("pred", "tn" if own == guess else "fn", n - 1, kept, None))
        bucket = "fp" if own[0] == T.KEEP else "tp" if own == guess else "tpf"
        out += [("pred", bucket, n - 1, at, diff) for at, diff in changed]
    return out


# --- on DataFrames ------------------------------------------------------------


#: Results that a task keeps, as texts repeat.
KEPT = 20_000


def _with(df: DataFrame, work, columns: list[str], name: str, kind: str, cached: bool = False) -> DataFrame:
    """df with a column that plain Python makes of others, batch by batch; the rest of a batch is passed on as it is."""
    plain = df.drop(name)
    made_type = to_arrow_type(T_.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lru_cache(KEPT)(work) if cached else work
        for batch in batches:
            made = [own(*values) for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, made_type)], [*batch.schema.names, name])

    return plain.mapInArrow(run, T_.StructType([*plain.schema.fields, T_.StructField(name, T_.DataType.fromDDL(kind))]))


def _as_items(value) -> list[Item]:
    return [(x["token"], list(x["tags"])) for x in value]


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt evenly, as aligning a sentence costs far more than moving it and files may be few. Their number of parts follows from their size at
    run time (at least a part for each core, then spark.sql.adaptive.advisoryPartitionSizeInBytes), and large parts are split.
    by: rows that are equal in these columns come together, so that a task need not do the same work twice."""
    return rows.hint("rebalance", *by)


def with_tags(pairs: DataFrame, source: str = "src", target: str = "tgt", verbs: T.Verbs | None = None, checked: bool = True) -> DataFrame:
    """pairs with `items`, their tags. Checked: pairs whose tags don't give back the target (white space apart) are left out, as are
    pairs with a null side or with a mark of the file format."""

    forms = {(a, tag): b for (a, b), tag in verbs.items()} if verbs else None

    def work(a: str, b: str):
        found = align(a, b, verbs)
        if found is None or checked and "".join(decode(found, forms).split()) != "".join(b.split()):
            return None
        return [{"token": t, "tags": g} for t, g in found]

    known = spread(pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull()))
    return _with(known, work, [source, target], "items", ITEMS, cached=True).where("items is not null")


def with_decoded(tagged: DataFrame, name: str = "decoded", forms: T.Verbs | None = None) -> DataFrame:
    """tagged (items, ...) with the text that the tags make."""
    return _with(tagged, lambda items: decode(_as_items(items), forms), ["items"], name, "string")


def with_sites(pairs: DataFrame, variant: str = "build") -> DataFrame:
    """pairs (items, pred_items, tgt, pred_tgt, ...) with `sites`."""

    def work(gold, pred, target, guess):
        keys = ("side", "bucket", "src_pos", "tgt_pos", "diff")
        return [dict(zip(keys, s, strict=True)) for s in sites(_as_items(gold), _as_items(pred), target, guess, variant)]

    return _with(pairs, work, ["items", "pred_items", "tgt", "pred_tgt"], "sites", SITES)


def site_rows(pairs: DataFrame, *keys: str, source: str = "src", target: str = "tgt", predicted: str = "pred_tgt", variant: str = "build", verbs: T.Verbs | None = None) -> DataFrame:
    """pairs (keys, source, target, predicted) -> keys, side, bucket, src_pos, tgt_pos, diff: the error sites of all pairs, in one pass.

    Both targets are aligned with the source and walked in the same batch, so tags never leave it. Pairs with a null text, or whose tags
    don't give back their target, give no sites.
    """
    forms = {(a, tag): b for (a, b), tag in verbs.items()} if verbs else None

    def tags(a: str, b: str) -> list[Item] | None:
        found = align(a, b, verbs)
        return found if found is not None and "".join(decode(found, forms).split()) == "".join(b.split()) else None

    def work(a: str, b: str, guess: str) -> list[tuple]:
        gold = tags(a, b)
        pred = gold if guess == b else tags(a, guess)
        return [] if gold is None or pred is None else sites(gold, pred, b, guess, variant)

    columns = (("side", pa.string()), ("bucket", pa.string()), ("src_pos", pa.int32()), ("tgt_pos", pa.int32()), ("diff", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lru_cache(KEPT)(work)
        for batch in batches:
            made = [own(*values) for values in zip(*(batch.column(c).to_pylist() for c in (source, target, predicted)), strict=True)]
            rows = batch.select(list(keys)).take(pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made])))
            flat = list(zip(*(site for m in made for site in m), strict=True)) or [()] * len(columns)
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(v, t) for v, (_, t) in zip(flat, columns, strict=True))], [*keys, *(n for n, _ in columns)])

    known = spread(pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull() & F.col(predicted).isNotNull()).select(*keys, source, target, predicted))
    kind = T_.StructType([*(known.schema[k] for k in keys), *T_.StructType.fromDDL("side string, bucket string, src_pos int, tgt_pos int, diff string").fields])
    return known.mapInArrow(run, kind)


def exploded_sites(with_sites_: DataFrame, *keys: str) -> DataFrame:
    """A row for each site of with_sites(), numbered."""
    return numbered_sites(with_sites_.select(*keys, F.explode("sites").alias("s")).select(*keys, "s.*"), *keys)


def numbered_sites(rows: DataFrame, *keys: str) -> DataFrame:
    """Sites with `site`, their number by source and target position within their line, side and bucket."""
    order = Window.partitionBy(*keys, "side", "bucket").orderBy("src_pos", "tgt_pos", "diff")
    return rows.withColumn("site", F.row_number().over(order) - 1)


def prefixes(lines: DataFrame, site_rows: DataFrame, lang: str = "en", key: str = "line_no") -> DataFrame:
    """site_rows (key, src_pos, tgt_pos, ...) with the prefixes that end at their tokens, for lines (key, src, tgt).

    Sites at -1, outside the line or at punctuation are left out; those that stay are numbered again (rank, from 0) in their order.
    """
    tokens = lines.select(key, F.trim("src").alias("__src"), F.trim("tgt").alias("__tgt"))
    out = site_rows.join(tokens, key).withColumn("src_tokens", blank_tokens(F.col("__src"))).withColumn("tgt_tokens", blank_tokens(F.col("__tgt")))
    src, tgt = F.get("src_tokens", F.col("src_pos")), F.get("tgt_tokens", F.col("tgt_pos"))
    inside = (F.col("src_pos") >= 0) & (F.col("tgt_pos") >= 0) & (F.col("src_pos") < F.size("src_tokens")) & (F.col("tgt_pos") < F.size("tgt_tokens"))
    out = out.where(inside).where(~T.is_punctuation(src, lang) & ~T.is_punctuation(tgt, lang)).drop("src_tokens", "tgt_tokens")
    order = Window.partitionBy(key, *(c for c in ("side", "bucket") if c in site_rows.columns)).orderBy("src_pos", "tgt_pos", *(["diff"] if "diff" in site_rows.columns else []))
    out = out.withColumn("rank", F.row_number().over(order) - 1)
    return out.withColumn("src_prefix", prefix(F.col("__src"), F.col("src_pos"))).withColumn("tgt_prefix", prefix(F.col("__tgt"), F.col("tgt_pos"))).drop("__src", "__tgt")


def cyclic(positive: Column, negative: Column) -> Column:
    """Two arrays -> array<struct<pos, neg>>: the negatives after the first, negative k with positive (k - 1) mod P. None without a positive.

    Both are bound first: a lambda would compute the expression that stands for the positives anew for each negative.
    """

    def paired(own: Column) -> Column:
        p, n = own["p"], own["n"]
        pairs = F.transform(F.slice(n, F.lit(2), F.greatest(F.size(n), F.lit(1))), lambda x, i: F.struct(F.get(p, i % F.size(p)).alias("pos"), x.alias("neg")))
        return F.when(F.size(p) > 0, pairs)

    return F.get(F.transform(F.array(F.struct(positive.alias("p"), negative.alias("n"))), paired), F.lit(0))


def cyclic_pairs(positive: DataFrame, negative: DataFrame, key: str = "line_no", rank: str = "rank") -> DataFrame:
    """cyclic() within each line of two tables (key, rank, ...): columns pos_* and neg_*.

    Both sides of a line are gathered in one pass, in the order of their ranks, and paired by their places; lines without a positive, or
    with one negative, give nothing.
    """
    kinds = [f"struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in df.schema.fields if f.name != key)}>" for df in (positive, negative)]
    row = lambda df: F.struct(F.col(rank).cast("bigint").alias("__rank"), F.struct(*(c for c in df.columns if c != key)).alias("row"))
    none = lambda kind: F.lit(None).cast(f"struct<__rank:bigint,row:{kind}>")
    both = positive.select(key, row(positive).alias("p"), none(kinds[1]).alias("n")).union(negative.select(key, none(kinds[0]).alias("p"), row(negative).alias("n")))
    side = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["row"])
    pairs = both.groupBy(key).agg(side("p").alias("p"), side("n").alias("n")).select(key, F.explode(cyclic(F.col("p"), F.col("n"))).alias("x"))
    names = lambda df, mark: [F.col("x")[mark][c].alias(f"{mark}_{c}") for c in df.columns if c != key]
    return pairs.select(key, *names(positive, "pos"), *names(negative, "neg"))


def tags_as_edits(items: Column) -> Column:
    """Items that aren't kept as array<struct<start, end, tags>>, positions counted without the start token."""
    numbered = F.transform(items, lambda x, i: F.struct((i - 1).alias("start"), i.alias("end"), x["tags"].alias("tags")))
    return F.filter(numbered, lambda e: e["tags"] != F.array(F.lit(T.KEEP)))


def edits_applied(tokens: Column, edits: Column) -> Column:
    """Tokens after edits (start, end, label, from left to right): an empty label deletes, an empty span inserts, REPLACE and TRANSFORM
    act on a token, MERGE joins it with the next."""
    start = F.struct(tokens.alias("out"), F.lit(0).alias("shift"))

    def step(acc: Column, e: Column) -> Column:
        at, label = e["start"] + acc["shift"], e["label"]
        head = lambda n: F.slice(acc["out"], F.lit(1), n)
        tail = lambda n: F.slice(acc["out"], n + 1, F.greatest(F.size(acc["out"]) - n, F.lit(0)))
        put = lambda new, upto, shift: F.struct(F.concat(head(at), new, tail(upto)).alias("out"), (acc["shift"] + shift).alias("shift"))
        one = lambda c: F.array(c)
        none = F.array().cast("array<string>")
        merged = F.struct(F.concat(head(at + 1), one(label), tail(at + 1)).alias("out"), (acc["shift"] + 1).alias("shift"))
        return (
            F.when(label == "", put(none, at + 1, -1))
            .when(e["start"] == e["end"], put(one(F.replace(label, F.lit(T.APPEND), F.lit(""))), at, 1))
            .when(label.startswith("$TRANSFORM_"), put(one(T.applied_column(F.get(acc["out"], at), label)), at + 1, 0))
            .when(label.startswith("$MERGE_"), merged)
            .when(e["start"] == e["end"] - 1, put(one(F.replace(label, F.lit(T.REPLACE), F.lit(""))), at + 1, 0))
            .otherwise(acc)
        )

    line = F.array_join(F.aggregate(edits, start, step)["out"], " ")
    return F.replace(F.replace(line, F.lit(f" {T.MERGE_HYPHEN} "), F.lit("-")), F.lit(f" {T.MERGE_SPACE} "), F.lit(""))
