"""N-gram Jaccard join, mixing, sharding, packing, and the steps of the pipeline."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emend.llm import jaccard, mixing, packing, sharding, shingles, stages
from emend.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(rows, k, num, den):
    """doc -> (size, smallest id), comparing all pairs; for rows (distinct id, text)."""
    sets = {i: sets_of(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            o = len(sets[i] & sets[j])
            if o and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "ü", "cc", " x", "d."]), max_size=12).map(lambda w: " \t\n"[len(w) % 3].join(w)), min_size=1, max_size=6), st.integers(2, 5))
def test_shingles(texts, k):
    got = list(shingles.shingle_sets([t.encode() for t in texts], k))
    want = [sets_of(t, k) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            assert len(a & b) == len(np.intersect1d(got[i], got[j]))
            assert (a == b) == (shingles.set_hash(got[i]) == shingles.set_hash(got[j])) or not (a or b)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([2, 4, 8, 12, 16, 19, 30, 80]))] for _ in range(25)]
    hot = [rng.choice(words) for _ in range(60)]
    line = [rng.choice(words) for _ in range(25)]
    out = []
    for i in range(n):
        t = list(hot) if i % 3 == 0 else list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            p = rng.randrange(len(t))
            t[p : p + rng.choice([0, 1])] = [rng.choice(words)] * rng.choice([0, 1, 1])
            t = t or ["x"]
        if i % 4 == 1:
            t = t + line
        out.append((i, " ".join(t).upper() if i % 7 == 0 else " ".join(t)))
    return out


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 4, 85, 100), (2, 5, 4, 5)])
def test_jaccard_agrees_with_all_pairs(spark, seed, k, num, den):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE two"), (905, "w1 " * 30_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()}
    assert got == plain_components(rows, k, num, den)


def test_a_large_group_near_the_threshold(spark):
    # far more members than a short list holds, about half of whose pairs are links: centres and blocks decide
    rng = random.Random(3)
    base = [f"v{i}" for i in range(90)]
    rows = []
    for i in range(260):
        t = list(base)
        for p in rng.sample(range(90), rng.choice([0, 1, 2, 3])):
            t[p] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    want = plain_components(rows, 4, 85, 100)
    assert got == {i: c for i, (_, c) in want.items()} and len(set(got.values())) > 1


def test_jaccard_odd_tables(spark):
    df = spark.createDataFrame([(5, "a b c d e f", "x"), (5, "a b c d e f", "y"), (None, "a b c d e f", "z"), (None, "q r s t u", None), (None, None, None)], "doc_id long, text string, node string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(df).collect())
    assert got == [("5", 2, "5"), ("5", 2, "5"), ("None", 0, "None"), ("None", 1, "None"), ("None", 2, "5")]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_lists_are_cut_across_batches():
    sim = jaccard.Similarity(4, 85, 100)
    rng = random.Random(0)
    rows = sorted({(h, node, 100, rng.randrange(3), 0) for h, g in ((1, 1), (2, 3), (3, 40), (4, 32), (5, 90), (6, 2)) for node in range(g)})
    rows = sorted(rows + rows[:7])

    def run(size):
        batches = (pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], ["hash", "node", "n", "pos", "late"]) for i in range(0, len(rows), size))
        out = [r for b in jaccard._lists(batches, sim, 10) for r in b.to_pylist()]
        return sorted(map(str, out))

    whole = run(10_000)
    assert all(run(n) == whole for n in (1, 7, 33, 64)) and len([r for r in whole if "'hash': 5" in r]) == 90


def test_subsets_prove_links():
    for num, den in ((85, 100), (4, 5)):
        sim = jaccard.Similarity(4, num, den)
        for s in range(1, 40):
            for t in range(s, 50):
                need = sim.need(s, t)
                assert den * need >= num * (s + t - need) and (den * (need - 1) < num * (s + t - need + 1))
                if need <= s:
                    assert t in sim.partners(s) and s in sim.partners(t) and sim.prefix(s) >= s - need + 1 and sim.prefix(t) >= t - need + 1
                else:
                    assert den * s < num * t


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing -------------------------------------------------------------------


def documents(spark, n=600, seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * max(0, int(rng.lognormvariate(3, 1)))), rng.choice(["a", "a", "a", "b", "c", "ü", None])) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "null id", "a"), (n, None, "a"), (n, None, "a"), (1, rows[1][1], rows[1][2]), (n + 1, "big " * 20_000, "b")], "doc_id long, text string, source string").withColumn("size", F.lit("clash"))


def plain_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark):
    df = documents(spark)
    rows = mixing.mix(df).collect()
    src = {r.doc_id: r.source for r in df.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = src[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert len(rows) == df.count()
    for s, t in plain_targets(sizes).items():
        assert abs(target[s] - t) < 1e-6 * max(1, t) and abs(taken[s] - t) <= max(0.02 * t, 30), s
    again = mixing.mix(df.repartition(7)).select("doc_id", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(df).select("doc_id", "size", "taken").collect())
    assert mixing.mix(df.limit(0)).count() == 0
    empty = mixing.mix(df.where("text is null")).collect()
    assert {(r.target, r.taken) for r in empty} == {(0.0, 0)}


def test_mix_agrees_with_its_sql(spark, tmp_path):
    df = documents(spark, 200, 5).drop("size")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: (str(r[0]), r[1], r[2], round(float(r[3]), 6), r[4])
    want = sorted(key(r) for r in con.sql(mixing.OP5_SQL).fetchall())
    assert sorted(key(r) for r in mixing.op5_mix(spark, str(tmp_path)).collect()) == want


def test_a_cut_reads_the_ranks_once_a_step_and_joins_nothing_else(spark, monkeypatch):
    """Each table that is broadcast takes megabytes of the driver, however few its rows."""
    plans, write = [], mixing.durable
    monkeypatch.setattr(mixing, "durable", lambda df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, label))
    assert mixing.mix(documents(spark, 50)).count() == 55
    joins = [(label, len(re.findall(r"\bJoin ", plan))) for label, plan in plans]
    assert [n for label, n in joins if label == "mix-cuts"] == [1] * mixing.CUTS and sum(n for _, n in joins) <= 9


def test_inclusion_follows_the_probabilities(spark):
    # 150 sources with the same sizes, each a draw of its own; what the first cut leaves goes to one or two small documents of a source
    sizes = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89] * 20 + [700]
    rows = [(1000 * s + i, "w " * n, f"s{s:03}") for s in range(150) for i, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,)).collect()
    share, p, n = Counter(), {}, Counter()
    for r in got:
        share[r.size] += r.copies - 1
        n[r.size] += 1
        p.setdefault(r.size, r.p)
        assert abs(p[r.size] - r.p) < 1e-9 and abs(r.target - 1.5 * r.source_size) < 1e-6
    words = sum(sizes)
    assert abs(sum(p[s] * s for s in sizes) - words / 2) < 1e-6 and p[700] == 1 and 0 < p[1] < p[89] < 1
    assert p[34] / p[2] == pytest.approx(17) and share[700] == n[700]
    for s in set(sizes) - {700}:
        assert abs(share[s] / n[s] - p[s]) < 0.04, (s, share[s] / n[s], p[s])


def test_shuffled_probabilities_change_the_choice(spark):
    sizes = [5 + 7 * i % 90 for i in range(200)]
    pick = lambda own: {r.doc_id for r in mixing.mix(spark.createDataFrame([(i, "w " * s, "a") for i, s in enumerate(own)], "doc_id long, text string, source string"), weights=(1,)).collect() if r.copies == 2}
    assert pick(sizes) != pick(sizes[::-1])


def test_a_long_document_can_be_drawn(spark):
    rows = [(i, "w " * 10, "a") for i in range(10)] + [(10, "w " * 10_000, "a"), (11, "w " * 15_486, "b")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,)).collect()}
    assert got[10].p > 0.9 and sum(r.taken for r in got.values() if r.doc_id != 11) >= 20_000


# --- sharding -----------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 9))
def test_smallest_capacity(sizes, shards):
    ends = np.cumsum(sizes)
    best = sharding.smallest_capacity(ends, max(max(sizes), -(-sum(sizes) // shards)), shards)
    # dynamic programme over all contiguous partitions
    upto = [0, *ends.tolist()]
    cost = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        cost = [0] + [min(max(cost[j], upto[i] - upto[j]) for j in range(i)) for i in range(1, len(upto))]
    assert best == cost[-1]
    cuts = [0, *sharding.even_cuts(ends, best, shards), int(ends[-1])]
    assert all(0 <= b - a <= best for a, b in zip(cuts, cuts[1:])) and set(cuts) <= set(upto)


def test_shards(spark):
    rng = random.Random(4)
    texts = [f"t{i} " * rng.randrange(1, 40) for i in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(1500)] + [(None, None), (7, ""), (7, ""), (8, "same " * 2000), (9, "same " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = sharding.shard(df, 10).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    groups = Counter()
    for r in got:
        groups[r.digest] += r.size
    ends = np.cumsum([groups[g] for g in sorted(groups)])
    assert max(size.values()) == sharding.smallest_capacity(ends, max(groups.values()), 10)
    assert all(len({r.shard for r in got if r.digest == g}) == 1 for g in groups)
    for s in size:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(df.limit(0), 10).count() == 0 and len(got) == len(rows)
    again = sharding.shard(df.repartition(7), 10).drop("digest").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in sharding.shard(df, 10).drop("digest").collect())
    assert {r.shard for r in sharding.shard(df.limit(2), 40).collect()} <= set(range(40))


def test_segments_are_split_until_cuts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DIGITS", 1)
    monkeypatch.setattr(sharding, "MOST_SEGMENTS", 300)
    rng = random.Random(6)
    groups = spark.createDataFrame([(f"{rng.getrandbits(128):032x}", rng.randrange(1, 90)) for _ in range(2000)], "digest string, bytes long").cache()
    capacity, starts = sharding.minimax_cuts(groups, 9)
    rows = sorted(map(tuple, groups.collect()))
    assert capacity == sharding.smallest_capacity(np.cumsum([b for _, b in rows]), 90, 9)
    total = Counter()
    for d, b in rows:
        total[sum(d >= s for s in starts)] += b
    assert max(total.values()) <= capacity


# --- packing ------------------------------------------------------------------


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = packing.best_fit([60, 50, 40, 30], ["a", "b", "c", "d"], [None, None, None, None], 100, 1)
    assert bins == [0, 1, 0, 1]
    assert packing.best_fit([60, 50, 40], ["a", "b", "c"], ["x", "y", "x"], 100, 1) == [0, 1, 1]  # the tightest holds a copy
    assert packing.best_fit([60, 50, 40], ["a", "b", "a"], [1, 2, 3], 100, 1) == [0, 1, 1]
    assert packing.best_fit([40, 40, 40], ["a"] * 3, ["x"] * 3, 100, 9) == [0, 1, 2]


def test_pack(spark):
    df = documents(spark, 800, 9).drop("size").withColumn("bin_id", F.lit("clash"))
    got = packing.pack(df, capacity=256, per_source=3, together=200).collect()
    words = sum(len((r.text or "").split()) for r in df.collect())
    assert sum(r.size for r in got) == words
    by = {}
    for r in got:
        if r.bin_id is not None:
            by.setdefault(r.bin_id, []).append(r)
    info = {r.doc_id: (r.source, r.text) for r in df.collect()}
    for own in by.values():
        assert sum(r.size for r in own) <= 256
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == [sum(x.size for x in own[:i]) for i in range(len(own))]
        assert max(Counter(info[r.doc_id][0] for r in own).values()) <= 3 and len({info[r.doc_id][1] for r in own}) == len(own)
    pieces = sorted((r.start, r.size) for r in got if r.doc_id == 801)
    assert pieces[0] == (0, 256) and sum(s for _, s in pieces) == 20_000
    assert [r.bin_id for r in got if r.doc_id == 800] == [None, None]
    assert packing.pack(df.limit(0)).count() == 0
    again = packing.pack(df.repartition(7), capacity=256, per_source=3, together=200).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def naive_best_fit(pieces, capacity, per_source):
    """Every piece looks at every bin: (size, source, cluster) by falling size -> bins."""
    bins, out = [], {}
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        size, source, cluster = pieces[i]
        fits = [(capacity - sum(pieces[j][0] for j in own), b) for b, own in enumerate(bins)]
        fits = [(room - size, b) for room, b in fits if room >= size and (cluster is None or all(pieces[j][2] != cluster for j in bins[b])) and sum(pieces[j][1] == source for j in bins[b]) < per_source]
        if not fits:
            bins.append([])
            fits = [(0, len(bins) - 1)]
        out[i] = min(fits)[1]
        bins[out[i]].append(i)
    return [out[i] for i in range(len(pieces))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from(["a", "b", None]), st.sampled_from([None, 1, 2, 3])), max_size=40), st.integers(1, 4))
def test_best_fit_agrees_with_a_scan_of_all_bins(pieces, per_source):
    got = packing.best_fit(*([p[i] for p in pieces] for i in range(3)), 30, per_source)
    assert got == naive_best_fit(pieces, 30, per_source)


def test_pack_with_clusters_of_its_own(spark):
    rows = [(i, "a b c", "s", i % 2) for i in range(8)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string, near long"), capacity=6, cluster=F.col("near")).collect()
    by = {}
    for r in got:
        by.setdefault(r.bin_id, []).append(r.doc_id % 2)
    assert len(by) == 4 and all(sorted(v) == [0, 1] for v in by.values())


# --- steps --------------------------------------------------------------------


def test_steps_keep_the_columns_and_take_effect(spark):
    rows = corpus(1, 60)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = [(200, "12345 678", None, "a", 9), (201, None, "en", "a", 0), (202, 'w1 w2 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" w3', None, "b", 60), (5, dict(rows)[5], "en", "a", 1)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", "ab"[i % 2], len(t)) for i, t in rows] + extra, schema).cache()
    known = stages.known_languages(docs)
    assert known.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()} == {200, 201} and known.where("lang is null").count() == 0
    single = stages.without_near_duplicates(docs.where("doc_id <> 5 or lang = 'en'").dropDuplicates(["doc_id"]))
    want = plain_components([(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect()], 5, 4, 5)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    safe = {r.doc_id: r for r in stages.without_secrets(docs).collect()}
    assert safe[202].text == 'w1 w2 [SECRET]" w3' and safe[202].n_chars == len(safe[202].text) and safe[7].text == dict(rows)[7]
    mix = stages.mixed(docs)
    copies = Counter(r.doc_id for r in mix.collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert mix.columns == docs.columns and copies == +want


def test_near_duplicates_are_rows_not_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (None, a), (None, "other " * 3), (None, None), (8, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, row_no string, gone string")
    got = stages.without_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, a), (5, b), (7, c), (7, d), (None, "other " * 3), (None, None), (8, ""), (9, None)]))
    only = stages.without_near_duplicates(docs.where("doc_id is null or doc_id = 5"))
    assert sorted(str(r.doc_id) for r in only.where(F.col("text") == a).collect()) == ["5"]


@pytest.mark.parametrize("stage", [stages.known_languages, stages.without_near_duplicates, stages.without_secrets, stages.mixed, stages.packed])
def test_steps_on_odd_tables(spark, stage):
    names = ["found", "blob", "twice", "copies", "__row", "copy", "size", "lang_pred", "score", "row_no", "of", "c0", "p", "rank"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    secret = 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y'
    own = [(1, secret, "en", "a", 60), (2, "just some words here", None, None, 20), (2, "just some words here", None, None, 20), (None, "no id " * 9, "en", "a", 54), (3, None, "en", None, 0), (4, "", None, "b", 0)]
    docs = spark.createDataFrame([r + tuple(f"{n}!" for n in names) for r in own], schema)
    got = stage(docs)
    if stage is not stages.packed:
        assert got.columns == docs.columns and all(r[n] == f"{n}!" for r in got.collect() for n in names)
    assert got.where("doc_id = 1").count() >= 1
    assert stage(docs.limit(0)).count() == 0
    unlabelled = stages.known_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert stage is not stages.known_languages or sorted(str(r.doc_id) for r in unlabelled.collect()) == ["1", "2", "2", "None"]


def test_secrets_of_a_text_with_very_many(spark):
    import re
    import time

    from emend.llm import secrets

    text = "".join(f"x{i} password=abcdef{i % 7} token: q " for i in range(30_000))
    began = time.time()
    row = secrets.scan(spark.createDataFrame([(1, text), (2, "no"), (3, "password=abcdef")], "doc_id long, text string")).withColumn("clean", secrets.redacted(F.col("text"), F.col("found"))).where("doc_id = 1").first()
    want = [(m.start(), m.end()) for m in re.finditer(r"password=abcdef\d", text)]
    assert [(x.start, x.end) for x in row.found] == want and row.clean == re.sub(r"password=abcdef\d", "[SECRET]", text)
    assert time.time() - began < 60


def test_overlapping_secrets_are_one_mark(spark):
    from emend.llm import secrets

    spans = [(0, 5), (2, 3), (3, 8), (8, 9), (12, 15), (13, 14)]
    row = spark.createDataFrame([("0123456789abcdefgh", [(a, b, "k") for a, b in spans])], "text string, found array<struct<start:bigint,end:bigint,kind:string>>")
    assert row.select(secrets.redacted(F.col("text"), F.col("found"), "#")).first()[0] == "##9ab#fgh"
