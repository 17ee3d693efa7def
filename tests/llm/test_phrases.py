"""Phrase mining against a plain version that counts all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from emend.llm import phrases


def plain(rows, least, longest, most):
    every, out = {}, []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = every.setdefault(lang, Counter())
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang, f in every.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in f.items() if c >= least):
                continue
            score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def made(n, seed, vocabulary=12):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ÉTÉ", "été", "x", "a-b", "\x1f", " ", "日本", "y", "z", "q", "w"][:vocabulary]
    signs = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", "!?", " : "]
    return ["".join(rng.choice(words[: rng.choice([3, vocabulary])]) + rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


ODD = [(None, "en"), ("", None), ("...\n,", "en"), ("the", "en"), ("the the the the the the the the", "en"), ("Of the OF THE of the", None), (" of the ", "")]


@pytest.mark.parametrize("change", [{}, {"CHUNK": 24}, {"COMMON_SHARE": 0.0}, {"COMMON_SHARE": 0.02, "CHUNK": 7}, {"MOST_HELD": 200}, {"TABLE_BITS": 2}, {"MOST_RANKED": 20, "COMMON_SHARE": 0.05}])
def test_all_phrases_as_by_counting_all(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(1)
    rows = [(t, rng.choice(["en", "en", "fr", None])) for t in made(150, 4)] + ODD
    docs = spark.createDataFrame([(None, t, lang, "n") for t, lang in rows], "doc_id long, text string, lang string, word string").repartition(3)
    found = phrases.collocations(docs, least=3, longest=4, most=25)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, found.collect()))
    assert got == plain(rows, 3, 4, 25) and len(got) > 30


def test_a_long_text_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 1000)
    rows = [(" ".join(made(60, 9)) + "v" * 30_000 + " of " + "w" * 9_000 + " of x " * 50, "en"), ("of x", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(docs, least=2, longest=5, most=300).collect())) == plain(rows, 2, 5, 300)


def test_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_products_beyond_64_bits(spark):
    big = 10**12
    found = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big), ("en", "a b", 2, big)], "lang string, phrase string, words long, n long")
    totals = spark.createDataFrame([("en", 7 * big)], "lang string, n long")
    assert phrases._scored(found, totals).first()["score"] == 1000 * big * 7 * big // (6 * big * big)
