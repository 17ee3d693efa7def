"""Cross-tokenizer alignment against a plain version with other encoders."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from emend.llm import alignment
from emend.llm.tokenizers import A_FILE, B_FILE, TOKENIZERS, encoders, vocabulary_files


@pytest.fixture(scope="module")
def plain_encoders():
    a = Tokenizer.from_file(f"{TOKENIZERS}/{A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{B_FILE}")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(c): c for c in printable}
    for c in sorted(set(range(256)) - set(printable)):
        letter[chr(256 + len(letter) - len(printable))] = c

    def run(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        want = b" " + text.encode()
        return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == want == b"".join(bytes_b) else None

    return run


def spans(ids, parts):
    at, out = 0, []
    for i, p in zip(ids, parts, strict=True):
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def plain(rows, run):
    """All rows of the result, by comparing tokens pair by pair."""
    each, held = [], Counter()
    for doc_id, text in rows:
        found = run(text)
        if not found:
            each.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = spans(*found[:2]), spans(*found[2:])
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links, groups, lo = [], [], 0
        for hi in ends:
            own_a, own_b = ([x for x in side if lo <= x[1] and x[2] <= hi] for side in (a, b))
            links += [(x[0], y[0]) for x in own_a for y in own_b if x[1] < y[2] and y[1] < x[2]]
            groups.append(",".join(str(x[0]) for x in own_a) + "|" + ",".join(str(y[0]) for y in own_b))
            lo = hi
        held.update(set(links))
        each.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    return [(d, na, nb, g, len(links), sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links), h) for d, na, nb, g, links, h in each]


WORDS = ["the", "The", "straße", "naïve", "don't", "'s", "x='y'", "12345", "3.14", "日本語", "emoji🙂", "ÅNGSTRÖM", "á", "<|endoftext|>", "<s>", "</s>", "<0x41>", " ", "\t", "\n", "\n\n", "  ", "   x", "▁", "<unk>", "…", "http://a.b/c?d=e", "aaaaaaaaaaaaaaaa", "​", "\x1c", "\x85", "﻿", "I'll", "KEY=abcDEF0123456789"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "", "\n", "  "]) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_parts_encode_like_whole_texts(plain_encoders):
    coder = encoders(*vocabulary_files())
    assert coder.borders
    for text in [*texts(300, 1), " lead", "trail ", " ", "a  b", "x 's 'll"]:
        parts = coder.parts(text)
        assert " ".join(parts) == text
        found = plain_encoders(text)
        if found:
            assert coder.ids_a(parts).values.tolist() == found[0] and coder.ids_b(parts).values.tolist() == found[2]


def test_all_rows_as_by_comparing_all_tokens(spark, plain_encoders, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(150, 2))] + [(900, None), (901, ""), (901, " "), (None, "the the"), (902, "the the"), (902, "the the"), (903, "a▁b"), (904, "x" * 500 + "\n" * 50)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, pairs string").repartition(3)
    want = sorted(plain(rows, plain_encoders), key=str)
    assert sum(r[1] > 0 for r in want) > 100 and any(r[1] == 0 for r in want)
    assert sorted(map(tuple, alignment.aligned(docs).collect()), key=str) == want


def test_small_tables_and_cut_units_change_nothing(plain_encoders, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_TOKENS", 40)
    monkeypatch.setattr(alignment, "MOST_UNIT", 16)
    given = [*texts(40, 3), "wort" * 100, None, ""]
    columns, _, _, good = alignment._Aligner(encoders(*vocabulary_files())).batch(given)
    want = plain(list(enumerate(given)), plain_encoders)
    assert [tuple(columns[c][i] for c in ("n_a", "n_b", "n_groups", "n_links")) for i in range(len(given))] == [r[1:5] for r in want]
    assert columns["groups_sha256"] == [r[7] for r in want]


def test_an_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts(plain_encoders):
    text = "Häuser bauen. " * 20_000 + "x" * 300_000
    columns, _, _, _ = alignment._Aligner(encoders(*vocabulary_files())).batch([text, "Häuser"])
    assert columns["n_a"][0] > 100_000 and columns["n_links"][0] >= columns["n_groups"][0]
    assert columns["groups_sha256"][1] == plain([(0, "Häuser")], plain_encoders)[0][7]
