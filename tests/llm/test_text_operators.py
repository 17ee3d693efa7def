"""Chat formatting, language identification, personal data, secrets."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emend.llm import chat, langid, pii, secrets

# --- chat ---------------------------------------------------------------------

PIECES = st.lists(st.sampled_from(["\\", "</turn>", "<turn", " again", '"', "\n", "a b", "ü", "### Assistant:", "<", ">", "\\\\n"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text and "</turn>" not in re.sub(r"\\.", "#", chat.escape(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", 'o"d\\']), PIECES, st.integers(1, 9)), max_size=12), st.integers(4, 30), st.integers(0, 10))
def test_windows_give_every_turn_once(turns, budget, history):
    own = [chat.Turn(*t) for t in turns]
    new, targets = [], []
    for w in chat.windows(own, budget, history):
        read = list(chat.read_turns(w.text, w.loss))
        assert w.tokens <= budget or sum(not r[2] for r in read) == 1 or all(r[0] == "system" for r in read) or w.new == 1 or any(t.tokens > budget - 9 for t in own) or read[0][0] == "system"
        new += [(r[0], r[1]) for r in read if not r[2]]
        targets += [r[3] for r in read if r[3] is not None]
        assert all(r[3] is None for r in read if r[2])
    assert new == [(t.role, t.text) for t in own]
    assert targets == [t.text for t in own if t.role == "assistant" and t.text]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string, window long")


def test_chat_over_tables(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"{'w ' * 150}{t} </turn> \\", "x", 3) for t in range(12)] + [(1, -1, "system", "sys", None, None), (2, None, None, None, None, None), (None, 0, "assistant", "null id", None, None), (3, 0, "user", "same", None, None), (3, 0, "user", "same", None, None), (4, 0, "assistant", "long " * 3000, None, None)]
    df = conversations(spark, rows)
    formatted = chat.format_chat(df)
    ws = formatted.where("conv_id = 1").orderBy("window").collect()
    assert len(ws) > 1 and all(w.text.startswith('<turn role="system"') and not w.over for w in ws)
    assert " again>" in ws[1].text and formatted.where("conv_id = 4").first().over
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((-(10**9) if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(t for _, role, t in own if role == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(said)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


# --- languages ----------------------------------------------------------------


def test_families_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where("not held_out"), per_language=80)
    pairs = {frozenset(model.languages[i] for i, f in enumerate(model.family) if f == g) for g in set(model.family)}
    assert pairs == {frozenset(("fr", "es")), frozenset(("de", "en"))} and len(model.sides) == 3
    assert langid.families_of(["en", "xx", "de-AT", "zz"]) == [2, 0, 2, 1]
    out = langid.identify(docs.where("held_out").withColumn("lang_pred", F.lit("clash")), model)
    rows = out.select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_the_driver_trains_nothing_and_gets_weights_alone(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang")
    rows = sorted((r.lang, hashlib.md5(r.text.encode()).hexdigest(), r.text) for r in langid.training_sample(docs, 30).select("lang", "text").collect())
    want = langid.train([langid.counted(t.encode()) for _, _, t in rows], [lang for lang, _, _ in rows])
    monkeypatch.setattr(langid, "linear_svm", None)  # on the driver; executors import the module themselves
    got = langid.fit(docs, 30)
    assert (got.languages, got.family, got.sides) == (want.languages, want.family, want.sides)
    assert langid.np.allclose(got.weights, want.weights, rtol=1e-4, atol=1e-6) and langid.np.allclose(got.bias, want.bias, atol=1e-6)


def test_odd_texts_and_models(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 $$$ ½ ²"), (4, "the " * 50_000), (None, "der die das und nicht"), (4, "x")], "doc_id long, text string")
    model = langid.train([langid.counted(t) for t in (b"the and of to in that it is", b"der die das und nicht ein ist")] * 3, ["en", "de"] * 3)
    got = {(r.doc_id, (r.text or "")[:3]): (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert got[1, ""] == got[2, ""] == got[3, "123"] == ("und", 0.0) and got[4, "the"][0] == "en" and got[None, "der"][0] == "de"
    assert {r.lang_pred for r in langid.identify(df, langid.train([langid.counted(b"a b")], ["xx"])).collect()} == {"und", "xx"}
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(none, langid.fit(none)).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_prediction_does_not_depend_on_the_batch():
    model = langid.train([langid.counted(t) for t in (b"the and of to", b"der die das und", b"le la les des", b"el los las del")], ["en", "de", "fr", "es"])
    texts = [b"the cat", b"x" * 300_000, b"les chats", b"la", b""]
    letters = langid.np.ones(len(texts), bool)
    whole = model.predict(texts, letters)
    for i, t in enumerate(texts):
        one = model.predict([t], letters[:1])
        assert one[0][0] == whole[0][i] and abs(one[1][0] - whole[1][i]) < 1e-6


# --- personal data ------------------------------------------------------------

PRIVATE = [
    ("Mail me@x-y.org or ME@X-Y.org now", 2, ["me@x-y.org", "ME@X-Y.org"]), ("call +1 (499) 555-6503%%% x", 1, ["(499) 555-6503"]), ("at 152.143.123.131### y", 1, ["152.143.123.131"]),
    ("pay 4845168114407329 or 7536784127813050 4845168114407329", 2, ["4845168114407329"]), ("ask Mr. John Smith and Mrs Smith, Frau MÜLLER", 4, ["John", "Smith", "MÜLLER"]), ("Господин Иван Петров", 2, ["Иван", "Петров"]),
]


def test_entities():
    for text, n, _ in PRIVATE:
        assert len(pii.entities(text)) == n, text
    for clean in ("9807915762804490 is no card", "version 1.2.3.4.5", "Missing Mister words", "a@b", "token = \"7c72db563d7f6e50\"", "1234", "pi 3.14159", "", "300.1.1.1"):
        assert not pii.entities(clean), clean
    assert pii.is_card("4845168114407329") and not pii.is_card("4845168114407328")


@pytest.mark.parametrize(("kind", "normal", "gender"), [("mail", "that.92@mail2.example.com", ""), ("ip", "1.2.3.4", ""), ("ipv6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", ""), ("iban", "DE89370400440532013000", ""), ("ssn", "536225341", ""), ("card", "4845168114407329", ""), ("card", "378282246310005", ""), ("phone", "4995556503", ""), ("name", "mary", "f"), ("name", "петров", "m"), ("name", "smith-jones", ""), ("name", "o'brien", ""), ("name", "אברהם", "")])
def test_surrogates_keep_type_and_form(kind, normal, gender):
    made = {pii.draw(kind, normal, b"k", a, gender) for a in range(5)}
    assert len(made) == 5 and made == {pii.draw(kind, normal, b"k", a, gender) for a in range(5)} and pii.draw(kind, normal, b"other", 0, gender) not in made
    for s in made:
        assert pii.script_of(s) == pii.script_of(normal) or kind in ("ipv6", "iban")
        if kind == "card":
            assert pii.is_card(s) and len(s) == len(normal)
        if kind == "name":
            assert [c.isalpha() for c in s] == [c.isalpha() for c in normal] and s != normal
            assert not gender or s[-1] in pii.SCRIPTS[pii.script_of(s)][2 if gender == "m" else 3]
        else:
            place = {"phone": "+1 (499) 555-6503", "ssn": "536-22-5341", "iban": "DE89 3704 0044 0532 0130 00"}.get(kind, normal)
            text = pii.written(s, kind, place)
            assert [e.kind for e in pii.entities(f"x {text} y")] == [kind] and (len(text) == len(place) or kind in ("mail", "ip", "ipv6"))
    assert pii.written("marina", "name", "MARIAM") == "MARINA" and pii.written("marinad", "name", "McDonal") == "MaRinad" and pii.written("o'brien", "name", "O’Shean") == "O’Brien"


def test_names_are_found_again():
    kinds = lambda t: [(t[e.start : e.end], e.gender) for e in pii.entities(t)]
    assert kinds("Mr John Smith came. Smith said hello to John, and SMITH's dog barked; smith is a word.") == [("John", "m"), ("Smith", ""), ("Smith", ""), ("John", ""), ("SMITH", "")]
    assert kinds("My name is John Smith") == [("John", ""), ("Smith", "")] and kinds("my name is Dr Weber") == [("Weber", "")]
    assert kinds("Mrs O'Brien's house") == [("O'Brien", "")] and kinds("Smith and Jones") == []
    assert kinds("time 12:34:56, a::b, std::x, 3/4-12") == [] and [e.kind for e in pii.entities("at fe80::1ff:fe23:4567:890a or DE89370400440532013000, 536-22-5341 but DE88370400440532013000")] == ["ipv6", "iban", "ssn"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Frau Dr. Müller und Müllers Hund", [("Müller", "name"), ("Müller", "name")]),
        ("Prof. Dr. Weber, Herr Prof. Dr. Jan Weber", [("Weber", "name"), ("Jan", "name"), ("Weber", "name")]),
        ("Frau Dr. sagt nichts", []),
        ("at 2001:db8::1, fe80::1 and ::ffff", [("2001:db8::1", "ipv6"), ("fe80::1", "ipv6")]),
        ("std::x a::b 12:34:56 10::20", []),
        ("+49 151 12345678 oder 0151 12345678", [("+49 151 12345678", "phone"), ("0151 12345678", "phone")]),
        ("030 1234567, 01 23 45 67 89.", [("030 1234567", "phone"), ("01 23 45 67 89", "phone")]),
        ("0151 12345678 10 times", [("0151 12345678", "phone")]),
        ("am 01-02-2020 10, 012-34-5678, 0.15 1234567, 555-1234", [("012-34-5678", "ssn")]),
    ],
)
def test_what_is_found(text, want):
    assert [(text[e.start : e.end], e.kind) for e in pii.entities(text)] == want


def test_a_number_has_one_form():
    assert {pii.national(x) for x in ("+49 151 12345678", "0151 12345678", "+49 (0)151 12345678")} == {"15112345678"}
    assert pii.national("+1 (499) 555-6503") == pii.national("499-555-6503") == "4995556503" and pii.national("+353 1 234 5678") == "12345678"
    new = pii.draw("phone", "15112345678", b"k")
    abroad, home = (pii.written(new, "phone", x) for x in ("+49 151 12345678", "0151 12345678"))
    assert abroad == f"+49 {new[:3]} {new[3:]}" and home == f"0{new[:3]} {new[3:]}" and "151" not in (new[:3],)
    assert [e.gender for e in pii.entities("Frau Prof. Dr. Anna Weber")] == ["f", ""]


def test_long_runs_of_digits_and_titles_cost_little():
    began = time.time()
    assert not pii.entities("01 " + "12 " * 50_000 + "x" + "1" * 100_000 + "x " + "0:" * 50_000 + "Dr. " * 50_000)
    assert time.time() - began < 20


def plain_pseudonymise(texts, key):
    """One text after the other, with plain dicts: votes for genders, draws until nothing collides, then the spans are cut out."""
    votes = {}
    for t in texts:
        for e in pii.entities(t or ""):
            v = votes.setdefault((e.kind, e.normal), {"m": 0, "f": 0, "": 0})
            v[e.gender] += 1
    gender = {x: "m" if v["m"] > v["f"] else "f" if v["f"] > v["m"] else "" for x, v in votes.items()}
    attempt = dict.fromkeys(votes, 0)
    while True:
        holder = {}
        for x in sorted(votes, key=lambda x: (attempt[x], x[1])):
            holder.setdefault((x[0], pii.draw(*x, key, attempt[x], gender[x])), x)
        clash = [x for x in votes if (made := (x[0], pii.draw(*x, key, attempt[x], gender[x]))) in votes or holder[made] != x]
        if not clash:
            break
        for x in clash:
            attempt[x] += 1
    out = []
    for t in texts:
        for e in reversed(pii.entities(t or "")):
            x = (e.kind, e.normal)
            t = t[: e.start] + pii.written(pii.draw(*x, key, attempt[x], gender[x]), e.kind, t[e.start : e.end]) + t[e.end :]
        out.append(t)
    return out


PEOPLE = ["Dr Anna Weber and Mrs Anna Weber met. Anna left with Weber.", "Mr Li Wu saw Ms Li Wu and Mr. Li Bo", "Mrs ANNA weber, Frau Anna O'Brien", "call 499-555-6503 or +1 (499) 555-6503", "My name is Bo. Bo, Li and Wu know Mr Bo Li."]


def test_pseudonymise(spark, monkeypatch):
    rows = [(i, t, "x") for i, (t, _, _) in enumerate(PRIVATE)] + [(90, None, None), (91, "", None), (92, "clean text 123", None), (None, "me@x-y.org", None), (0, PRIVATE[0][0], "x"), (93, "w " * 200_000 + "me@x-y.org", None)] + [(100 + i, t, "x") for i, t in enumerate(PEOPLE)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities string")
    got = pii.pseudonymise(df, b"key").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[90].text is None and by[91].text == "" and by[92].text == "clean text 123" and by[92].n_entities == 0
    for i, (_, n, parts) in enumerate(PRIVATE):
        assert by[i].n_entities == n and not any(p in by[i].text for p in parts)
        assert all(s.start < s.end for s in by[i].surrogates)
    mail = by[None].text
    assert mail in by[0].text and by[93].text.endswith(mail)  # one surrogate wherever it is
    names = by[4].text
    assert re.search(r"Mr\. \w+ (\w+) and Mrs \1,", names) and re.search(r"Frau [A-ZÄÖÜ]+$", names)
    assert "7536784127813050" in by[3].text
    one = re.fullmatch(r"Dr (\w+a) (\w+) and Mrs \1 \2 met\. \1 left with \2\.", by[100].text)
    assert one and len(one[1]) == 4 and len(one[2]) == 5 and "Anna" not in by[100].text
    assert re.fullmatch(r"call (\d{3})-(\d{3})-(\d{4}) or \+1 \(\1\) \2-\3", by[103].text)
    assert pii.pseudonymise(df.limit(0), b"key").count() == 0
    want = sorted(map(str, plain_pseudonymise([r[1] for r in rows], b"key")))
    assert sorted(str(r.text) for r in got) == want
    monkeypatch.setattr(pii, "MOST_KNOWN", 0)
    assert sorted(str(r.text) for r in pii.pseudonymise(df, b"key").collect()) == want


def test_collisions_are_drawn_again(spark):
    # of so many 7-digit numbers some surrogates collide, or are numbers of the corpus
    rows = spark.range(3000).select(F.format_string("(212) %03d-%04d", (F.col("id") % 10).cast("int"), F.col("id").cast("int")).alias("text"), F.col("id").alias("doc_id"))
    out = pii.pseudonymise(rows, b"k").collect()
    assert len({r.text for r in out}) == 3000
    ips = spark.range(254 * 4).select(F.concat(F.lit("10.0."), (F.col("id") / 254).cast("int").cast("string"), F.lit("."), (F.col("id") % 254).cast("string")).alias("text"))
    assert pii.pseudonymise(ips, b"k").select("text").distinct().count() == ips.distinct().count()
    # more names of two letters than there are surrogates of two: some become longer
    short = [f"Mr {a}{b}" for a in "ABCDEFGHIJKLMNOP" for b in "abcdefghijklmnop"]
    made = [r.text for r in pii.pseudonymise(spark.createDataFrame([(t,) for t in short], "text string"), b"k").collect()]
    assert len(set(made)) == len(short) and not set(made) & set(short)


# --- secrets ------------------------------------------------------------------

TEXTS = [
    'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "password:abc token: token: abcdefgh", "ÜÜ AKIA" + "A" * 16 + " AKIAB", "api_key='k-1.2_3=' APIKEY=zzzzzz", "deadbeef" * 3 + "x" + "deadbeef" * 2,
    "", None, "nothing here", "ghp_" + "a" * 36, "SECRET = abcdef, secret=abc", "0" * 100_000, "passwd\"  :  \"longvalue\" token=token=abcdefgh",
]


def plain_spans(text):
    found = []
    for rank, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern.replace("(?i:", "(?ai:"), text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), rank, m.end(), rule.kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_secrets_agree_with_a_plain_scan(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None), (0, TEXTS[0], None)], "doc_id long, text string, found string")
    got = secrets.scan(df).withColumn("d", secrets.digest(F.col("found"))).collect()
    assert len(got) == len(TEXTS) + 2 and sum(len(r.found) for r in got) > 8
    for r in got:
        assert r.d == ",".join(plain_spans(r.text)), r.text
    assert secrets.scan(df.limit(0)).count() == 0


def test_ledger_reads_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([(0, TEXTS[0]), (1, TEXTS[0]), (2, "clean")], "doc_id long, text string")
    first = secrets.RULES[:2]
    assert secrets.scan(df, first, path).where(F.size("found") > 0).count() == 2
    assert spark.read.parquet(path).count() == 2  # blobs, not documents
    secrets.scan(df, first, path).collect()
    assert spark.read.parquet(path).count() == 2
    more = df.union(spark.createDataFrame([(3, TEXTS[8])], "doc_id long, text string"))
    out = secrets.scan(more, secrets.RULES, path)
    assert {r.doc_id: sorted({x.kind for x in r.found}) for r in out.collect()} == {0: ["assign", "hex"], 1: ["assign", "hex"], 2: [], 3: ["github", "hex"]}
    ledger = spark.read.parquet(path).select(F.hex("blob").alias("b"), "rules").collect()
    assert len(ledger) == 5 and all(len(r.rules) in (2, 3, 5) for r in ledger)
    changed = (secrets.Rule("assign", r"NEVER", 0, 1, "NEVER", 2), *secrets.RULES[1:])
    assert {x.kind for r in secrets.scan(more, changed, path).collect() for x in r.found} == {"hex", "github"}


def test_redaction(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    out = {r.doc_id: r.t for r in secrets.scan(df).withColumn("t", secrets.redacted(F.col("text"), F.col("found"))).collect()}
    assert out[0] == 'x [SECRET]" y' and out[2] == "ÜÜ [SECRET] AKIAB" and out[5] == "" and out[6] is None and out[7] == "nothing here"
