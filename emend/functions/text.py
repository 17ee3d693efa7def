"""Text normalisation, answer extraction and retokenisation as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import INFIXES, peeled_line

ANSWER_START, ANSWER_END = "<corrected sentence>", "</corrected sentence>"
#: Clitics that are joined to the word before them.
CLITICS = ("n't", "'d", "'ll", "'m", "'re", "'s", "'ve")


def clean_space(text: Column) -> Column:
    """Runs of any white space (Unicode) become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Tokens between white space; none for an empty text."""
    return F.filter(F.split(clean_space(text), " "), lambda w: w != "")


def blank_tokens(text: Column) -> Column:
    """Tokens between single blanks, empty ones kept, as positions in tagged lines count them."""
    return F.split(F.trim(text), " ")


def join_words(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def line_breaks_to_blanks(text: Column) -> Column:
    return F.trim(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")))


def space_brackets(text: Column) -> Column:
    """The Romanian corpus' convention: a blank before an opening bracket, none after."""
    out = F.replace(text, F.lit("("), F.lit(" ( "))
    return F.replace(F.replace(out, F.lit("  "), F.lit(" ")), F.lit("( "), F.lit("("))


def runtime_line(text: Column, dataset: Column) -> Column:
    """A line as the scorer of the dataset reads it."""
    flat = line_breaks_to_blanks(text)
    return F.when(dataset.isin("ronacc_readerbench", "ronacc_readerbench_train"), space_brackets(flat)).otherwise(flat)


def chain(*rules: tuple[str, str]) -> Callable[[Column], Column]:
    """Regular expressions and replacements, one after the other."""

    def apply(text: Column) -> Column:
        for pattern, replacement in rules:
            text = F.regexp_replace(text, pattern, replacement)
        return text

    return apply


#: Patterns and replacements of the retokenisation chains, in order.
JOIN_CLITIC = (r" '\s?((?:m )|(?:ve )|(?:ll )|(?:s )|(?:d ))", "'$1")
CONLL_RULES = ((" ' (.*?) ' ", " '$1' "), (" - ", "-"), (" / ", "/"), (r"([\]\[\(\){}<>])", " $1 "), (r"\s+", " "))
BEA_RULES = ((r"(?<=\d)\s+%", "%"), ("((?:have)|(?:has)) n't", "$1n't"), ("^-", "- "), (r"\s+", " "))


def split_punctuation(text: Column) -> Column:
    """A plain tokeniser: words and single signs, joined by blanks. Stands in for an external model."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?U)[\w'’\-]+|[^\w\s]"), F.lit(0)), " ")


Tokenizer = Callable[[Column], Column]
#: Tokenisers by language; any other language keeps its blanks. External models can be put in here as pandas UDFs.
TOKENIZERS: dict[str, Tokenizer] = {lang: partial(peeled_line, lang=lang) for lang in INFIXES}


def retokenized(text: Column, lang: str) -> Column:
    return TOKENIZERS.get(lang, lambda c: c)(text)


def conll_text(text: Column, tokenizer: Tokenizer = lambda c: c) -> Column:
    return chain(*CONLL_RULES)(tokenizer(chain(JOIN_CLITIC)(text)))


def bea_text(text: Column, tokenizer: Tokenizer = lambda c: c) -> Column:
    return chain(*BEA_RULES)(tokenizer(chain(JOIN_CLITIC)(text)))


#: Steps for each dataset, by name, and the datasets that a step is for (None: all).
STEPS: dict[str, tuple[Callable[[Column], Column], tuple[str, ...] | None]] = {
    "line_breaks": (line_breaks_to_blanks, None),
    "ro_brackets": (space_brackets, ("ronacc_readerbench", "ronacc_readerbench_train")),
    "en_tokens": (partial(retokenized, lang="en"), ("wilocness",)),
    "de_tokens": (partial(retokenized, lang="de"), ("falko_merlin", "falko_merlin_train")),
    "et_tokens": (partial(retokenized, lang="et"), ("estgec", "estgec_train")),
    "ro_tokens": (partial(retokenized, lang="ro"), ("ronacc_readerbench", "ronacc_readerbench_train")),
    "conll14": (conll_text, ("conll14",)),
    "bea19": (bea_text, ("bea19",)),
}
PLANS: dict[str, tuple[str, ...]] = {
    "wilocness": ("line_breaks", "en_tokens"),
    "falko_merlin": ("line_breaks", "de_tokens"),
    "falko_merlin_train": ("line_breaks", "de_tokens"),
    "estgec": ("line_breaks", "et_tokens"),
    "estgec_train": ("line_breaks", "et_tokens"),
    "ronacc_readerbench": ("line_breaks", "ro_brackets", "ro_tokens"),
    "ronacc_readerbench_train": ("line_breaks", "ro_brackets", "ro_tokens"),
    "conll14": ("line_breaks", "conll14"),
    "bea19": ("line_breaks", "bea19"),
}


def postprocessed(text: Column, dataset: str, steps: tuple[str, ...] | None = None) -> Column:
    """The dataset's steps, in order; an error for an unknown dataset or a step that isn't for it."""
    if dataset not in PLANS:
        raise NotImplementedError(f"no post-processing for {dataset}")
    for name in steps or PLANS[dataset]:
        function, allowed = STEPS[name]
        if allowed is not None and dataset not in allowed:
            raise NotImplementedError(f"{name} is not for {dataset}")
        text = function(text)
    return text


def join_clitics(text: Column) -> Column:
    """Clitic tokens joined to the token before them."""
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, token: Column) -> Column:
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last(acc), token)))
        return F.when(token.isin(*CLITICS) & (F.size(acc) > 0), joined).otherwise(F.concat(acc, F.array(token)))

    return F.array_join(F.aggregate(words(text), F.array().cast("array<string>"), step), " ")


def without_doubles(text: Column) -> Column:
    """Tokens (between single blanks) that don't repeat the one before."""
    tokens = F.split(text, " ")
    return F.array_join(F.filter(tokens, lambda x, i: (i == 0) | (x != F.get(tokens, i - 1))), " ")


def strip_blanks(text: Column) -> Column:
    """Chinese texts carry no ASCII blanks."""
    return F.replace(text, F.lit(" "), F.lit(""))


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^\p{ASCII}*$")


# --- answers ------------------------------------------------------------------


def _find(text: Column, what: str) -> Column:
    """1-based place, 0 if absent."""
    return F.locate(what, text)


def tagged(response: Column, start: str = ANSWER_START, end: str = ANSWER_END) -> Column:
    """The text before an end tag that comes before any start tag, else between the tags; null if there is none or it is empty."""
    s, e = _find(response, start), _find(response, end)
    before = strip(F.substring(response, F.lit(1), e - 1))
    begin = s + len(start)
    after = F.substring(response, begin, F.length(response))
    close = _find(after, end)
    between = strip(F.substring(after, F.lit(1), close - 1))
    first = F.when((e > 0) & ((s == 0) | (e < s)) & (before != ""), before)
    return F.coalesce(first, F.when((s > 0) & (close > 0) & (between != ""), between))


#: All white space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at the ends, sign by sign: no regular expression that looks at every run of blanks."""
    return F.btrim(text, F.lit(WHITE))


def extract_answer(response: Column, source: Column) -> Column:
    """tagged(), or the source."""
    return F.coalesce(tagged(response), source)


def between_tags(text: Column, start: str, end: str) -> Column:
    """After the first start tag (or from the beginning), up to the next end tag (or the end)."""
    s = _find(text, start)
    after = F.when(s > 0, F.substring(text, s + len(start), F.length(text))).otherwise(text)
    return F.substring_index(after, end, 1)


def legacy_answer(response: Column, source: Column, start: str = ANSWER_START, end: str = ANSWER_END, none_found: str = "No errors found") -> Column:
    """Between the tags, the last sign of a long end tag not asked for; the source if a tag is missing, nothing is between them or there are no errors."""
    close = end[:-1] if len(end) >= 5 else end
    after = F.substring_index(F.substring(response, F.locate(start, response) + len(start), F.length(response)), start, 1)
    found = strip(F.substring_index(after, close, 1))
    has = lambda what: F.contains(response, F.lit(what))
    return F.when(has(start) & has(close) & ~has(none_found) & (found != ""), found).otherwise(source)


def split_answer(response: Column, source: Column, splitter: str) -> Column:
    """The second of three or more parts, if it is half to twice as long as the source; else the source."""
    parts = F.split(response, splitter.translate(str.maketrans({c: f"\\{c}" for c in r"\.[]{}()*+-?^$|"})))
    middle = strip(F.get(parts, F.lit(1)))
    ratio = F.length(middle) / F.nullif(F.length(source), F.lit(0))
    return F.when((F.size(parts) >= 3) & ratio.between(0.5, 2.0), middle).otherwise(source)


def answer(response: Column, source: Column, mode: str, splitter: str = "###") -> Column:
    """gec: legacy_answer; tagged: extract_answer; splitter: split_answer; normal: stripped; no: as it is."""
    modes = {
        "gec": lambda: legacy_answer(response, source),
        "tagged": lambda: extract_answer(response, source),
        "splitter": lambda: split_answer(response, source, splitter),
        "normal": lambda: strip(response),
        "no": lambda: response,
    }
    if mode not in modes:
        raise NotImplementedError(f"unknown mode {mode}")
    return modes[mode]()


# --- sentences ----------------------------------------------------------------


def pack_sentences(text: Column, budget: int, pattern: str = r"(?<=[.!?])\s+") -> Column:
    """Sentences of a text put together again, in order, while their words stay within the budget."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("part"), F.lit(-1).alias("n"))  # n: words of the open part, -1 without one

    def step(acc: Column, sentence: Column) -> Column:
        n = F.size(words(sentence))
        fits = (acc["n"] >= 0) & (acc["n"] + n <= budget)
        closed = F.when(acc["n"] >= 0, F.concat(acc["out"], F.array(acc["part"]))).otherwise(acc["out"])
        return F.when(fits, F.struct(acc["out"].alias("out"), F.concat_ws(" ", acc["part"], sentence).alias("part"), (acc["n"] + n).alias("n"))).otherwise(F.struct(closed.alias("out"), sentence.alias("part"), n.alias("n")))

    return F.aggregate(F.split(text, pattern), start, step, lambda acc: F.when(acc["n"] >= 0, F.concat(acc["out"], F.array(acc["part"]))).otherwise(acc["out"]))


#: Where long inputs of a dataset may be cut: after these signs.
CUTS = {"wilocness": r"(?<=[.!?])(?!\")", "mucgec": "(?<=[，,。!！?？])(?!”)", "fangzhenggrammar": "(?<=[，,。!！?？])(?!”)"}


def cut_long(rows: DataFrame, dataset: str, budget: int, count: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows (id, text, ...) cut at the dataset's signs and put together again up to a budget of tokens.

    Ids become `id#piece#mark`; the mark is the comma that a piece ends with, else P. Labels stay as they are. The budget is for tokens as `count` has it
    (words by default). In one dataset a piece also ends wherever it doesn't end with a comma.
    """
    if dataset not in CUTS:
        raise NotImplementedError(f"no cuts for {dataset}")
    n = count or (lambda c: F.size(words(c)))
    comma = lambda c: F.right(c, F.lit(1)).isin(",", "，")
    every = F.filter(F.split(strip(F.col("text")), CUTS[dataset]), lambda x: x != "")

    def step(acc: Column, piece: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, piece)))
        new = (F.size(acc) == 0) | (n(F.concat(last, piece)) >= budget)
        if dataset == "mucgec":
            new = new | ~comma(last)
        return F.when(new, F.concat(acc, F.array(piece))).otherwise(joined)

    packed = F.aggregate(every, F.array().cast("array<string>"), step)
    out = rows.withColumn("__pieces", packed).select("*", F.posexplode("__pieces").alias("__n", "__piece"), F.size("__pieces").alias("__of"))
    mark = F.when(comma(F.col("__piece")) & (F.col("__n") + 1 < F.col("__of")), F.right("__piece", F.lit(1))).otherwise("P")
    out = out.withColumn("id", F.concat_ws("#", F.col("id").cast("string"), F.col("__n").cast("string"), mark)).withColumn("text", F.col("__piece"))
    return out.select(*rows.columns)


def normalized(text: Column, replacements: dict[str, str] | None = None) -> Column:
    """Without doubled tokens, some texts replaced, in lower case."""
    out = without_doubles(text)
    for old, new in (replacements or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.lower(out)


def repaired(text: Column) -> Column:
    """Controls that are Windows-1252 signs read as Latin-1, as the signs they were meant to be."""
    codes = [c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    return F.translate(text, "".join(map(chr, codes)), bytes(codes).decode("cp1252"))


def prefix(line: Column, position: Column) -> Column:
    """A line of tokens between single blanks, up to and with that at a 0-based position: cut out of the line, no tokens are put together again."""
    return F.call_function("substring_index", line, F.lit(" "), (position + 1).cast("int"))


# --- Penn Treebank tokens -----------------------------------------------------

#: Patterns and replacements of the scorer's treebank convention, in order, as both Java and RE2 read them. First single signs and slashes,
#: then (ptb) brackets, quotes and contractions, then commas that aren't inside a number.
SIGN_RULES = ((r"([^\pL\pN_\s.'`,\-\"|/])", " $1 "), (r"\|", " -PIPE- "), (r"(\S)/(\S)", "$1 / $2"))
PTB_RULES = (
    (r"\(", " -LRB- "), (r"\)", " -RRB- "), (r"\[", " -LSB- "), (r"\]", " -RSB- "), (r"\{", " -LCB- "), (r"\}", " -RCB- "),
    (r'"\s*$', " '' "), (r'^\s*"', " `` "), (r'(\S)"\s', "$1 '' "), (r'\s"(\S)', " `` $1"), (r'(\S)"', "$1 '' "), (r'"(\S)', " `` $1"),
    (r"'\s*$", " ' "), (r"^\s*'", " ` "), (r"(\S)'\s", "$1 ' "), (r"\s'(\S)", " ` $1"),
    (r"'(ll|re|ve|LL|RE|VE)", " -CONTRACT-$1"), ("n't", " n-CONTRACT-t"), ("N'T", " N-CONTRACT-T"), ("([cC])annot", "$1an not"),
)
COMMA_RULES = ((r"(\D),(\D)", "$1 , $2"), (r"(\d),(\D)", "$1 , $2"), (r"(\D),(\d)", "$1 , $2"))
#: Apostrophes by language.
APOSTROPHE_RULES = {
    "en": ((r"([^a-zA-Z])'([^a-zA-Z])", "$1 ' $2"), (r"([^\pL\pN_])'([a-zA-Z])", "$1 ' $2"), (r"([a-zA-Z])'([^a-zA-Z])", "$1 ' $2"), (r"([a-zA-Z])'([a-zA-Z])", "$1 '$2"), (r"(\d)'(s)", "$1 '$2"), (r" '\s+s ", " 's "), (r" '\s+s ", " 's ")),
    "fr": ((r"([^a-zA-Z])'([^a-zA-Z])", "$1 ' $2"), (r"([^a-zA-Z])'([a-zA-Z])", "$1 ' $2"), (r"([a-zA-Z])'([^a-zA-Z])", "$1 ' $2"), (r"([a-zA-Z])'([a-zA-Z])", "$1' $2")),
}
#: Abbreviations that keep their period.
ABBREVIATIONS = {
    "en": tuple(
        "A B C D E F G H I J K L M N O P Q R S T U V W X Y Z Adj Adm Adv Asst Bart Bldg Brig Bros Capt Cmdr Col Comdr Con Corp Cpl DR Dr Drs Ens Gen Gov Hon Hr Hosp Insp Lt MM MR MRS MS Maj Messrs Mlle Mme Mr Mrs Ms Msgr "
        "Op Ord Pfc Ph Prof Pvt Rep Reps Res Rev Rt Sen Sens Sfc Sgt Sr St Supt Surg v vs i.e rev e.g Nos Nr".split()
    ),
    "fr": (),
}


def treebank_rules(lang: str, ptb: bool) -> tuple[tuple[str, str], ...]:
    """All patterns before words are looked at. Runs of dots or dashes are tokens of their own."""
    runs = ((r"(\.\.+)", " $1 "), (r"(--+)", " $1 "))
    return (*SIGN_RULES, *(PTB_RULES if ptb else ()), *runs, *COMMA_RULES, *APOSTROPHE_RULES[lang], ("' '", "''"))


def treebank(text: Column, lang: str = "en", ptb: bool = False) -> Column:
    """Tokens as the scorer's treebank convention has them (en, fr), joined by blanks; other languages are split by blanks.

    A word's period is a token of its own unless the word has further periods and a letter, is an abbreviation, or a number follows.
    """
    if lang not in APOSTROPHE_RULES:
        return clean_space(text)
    own = words(chain(*treebank_rules(lang, ptb))(F.concat(F.lit(" "), strip(text), F.lit(" "))))

    def word(w: Column, i: Column, every: Column) -> Column:
        before = F.left(w, F.length(w) - 1)
        inner = F.contains(before, F.lit(".")) & w.rlike("[a-zA-Z]")
        number = F.coalesce(F.get(every, i + 1).rlike(r"^\d"), F.lit(False))
        run = w.rlike(r"^\.+$")
        return F.when(w.endswith(".") & ~run & ~inner & ~before.isin(*ABBREVIATIONS[lang]) & ~number, F.concat(before, F.lit(" ."))).otherwise(w)

    once = F.transform(F.array(own), lambda every: F.transform(every, lambda w, i: word(w, i, every)))  # the rules run once, not once a word
    line = F.regexp_replace(join_words(F.get(once, F.lit(0))), r"'\s+'", "''")
    return clean_space(F.replace(line, F.lit("-CONTRACT-"), F.lit("'")))


def token_offset(text: Column, chars: Column, lang: str = "en") -> Column:
    """How many tokens the first `chars` characters have."""
    return F.size(words(treebank(F.substring(text, F.lit(1), chars), lang)))
