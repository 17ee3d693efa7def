"""The registered queries on the smallest tables, and the pipeline against its parts."""

import hashlib
import os
import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from emend.llm import langid, mixing, packing, queries

sys.path.insert(0, str(Path(__file__).parent))
from test_set_operators import naive_best_fit, plain_components  # noqa: E402
from test_text_operators import plain_spans  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in os.listdir(SF):
            con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
        want = con.sql(queries.ORACLE_SQL[name]).df()
        assert rows(got[want.columns]) == rows(want)


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "secret_scans", "source_mix", "best_fit_packing"]


def plain_language(model, text):
    """Trigram by trigram with the model's weights: families duel, then the languages of the winner."""
    if text is None or not any(c.isalpha() for c in text):
        return "und"
    codes = [int(c) for c in langid.trigrams(text.encode()) if c]
    margin = [sum(model.weights[c, d] for c in codes) / max(1, len(codes)) + model.bias[d] for d in range(len(model.sides))]

    def winner(level, options):
        votes = {o: [0, 0.0] for o in options}
        for d, (at, a, b) in enumerate(model.sides):
            if at == level and a in votes and b in votes:
                votes[a if margin[d] >= 0 else b][0] += 1
                votes[a][1] += margin[d]
                votes[b][1] -= margin[d]
        return max(options, key=lambda o: (*votes[o], -o))

    family = winner("family", sorted(set(model.family)))
    return model.languages[winner("language", [k for k, f in enumerate(model.family) if f == family])]


def plain_pack(rows):
    """(doc_id, source, text) -> the bins as sets of (doc_id, piece, size), by a scan of all bins."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (-size(r[2]), r[0], digest(r[2])))
    bins = [[(r[0], k, packing.CAPACITY)] for r in rows for k in range(size(r[2]) // packing.CAPACITY)]
    tails = [(size(r[2]) % packing.CAPACITY, r[1], digest(r[2]), r[0], size(r[2]) // packing.CAPACITY) for r in rows]
    tails = [t for t in tails if t[0]]
    chosen = naive_best_fit([t[:3] for t in tails], packing.CAPACITY, packing.PER_SOURCE)
    rests = [[] for _ in set(chosen)]
    for t, b in zip(tails, chosen, strict=True):
        rests[b].append((t[3], t[4], t[0]))
    return Counter(map(frozenset, bins + rests))


def test_pipeline_agrees_with_plain_stages(spark, tmp_path):
    """Each stage on its own input, against plain Python (or SQL) over the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    plain = lambda df: Counter(tuple(r[c] for c in columns) for r in df.collect())
    keyed = lambda rows: [dict(zip(columns, r, strict=True)) for r, n in rows.items() for _ in range(n)]
    back = lambda rows: Counter(tuple(r[c] for c in columns) for r in rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    run = dict(corpus_pipeline.STAGES)

    first = run[names[0]](spark, docs, SF).cache()
    model = langid.fit(docs)
    want = [r | {"lang": r["lang"] or guess} for r in keyed(plain(docs)) if (guess := plain_language(model, r["text"])) != "und"]
    assert plain(first) == back(want)

    second = run[names[1]](spark, first, SF).cache()
    linked = plain_components([(r.doc_id, r.text) for r in first.collect()], 5, 4, 5)
    assert plain(second) == back([r for r in keyed(plain(first)) if linked[r["doc_id"]][1] == r["doc_id"]])

    third = run[names[2]](spark, second, SF).cache()
    want = []
    for r in keyed(plain(second)):
        spans, text, at = [tuple(map(int, s.split(":")[1:])) for s in plain_spans(r["text"])], "", 0
        for begin, end in spans:
            if end <= at:
                continue
            text += (r["text"][at:begin] + "[SECRET]") if begin >= at else ""
            at = end
        want.append(r | ({"text": text + r["text"][at:], "n_chars": len(text + r["text"][at:])} if spans else {}))
    assert plain(third) == back(want)

    third.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    taken = {r[0]: r[4] // r[1] for r in con.sql(mixing.OP5_SQL).fetchall() if r[1]}
    fourth = run[names[3]](spark, third, SF).cache()
    assert plain(fourth) == Counter({r: n * taken[r[columns.index("doc_id")]] for r, n in plain(third).items() if taken.get(r[columns.index("doc_id")])})

    fifth = run[names[4]](spark, fourth, SF).collect()
    bins = {}
    for r in fifth:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append((r.doc_id, r.piece, r.size))
    assert Counter(frozenset(b) for b in bins.values()) == plain_pack([(r.doc_id, r.source, r.text) for r in fourth.collect()])

    whole = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.size) for r in whole) == Counter((r.doc_id, r.piece, r.size) for r in fifth)
