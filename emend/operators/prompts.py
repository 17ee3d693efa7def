"""Prompts from sentences and demonstrations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ANSWER_END, ANSWER_START, between_tags


@dataclass(frozen=True)
class Template:
    """System text; prompt with {examples}, {source} and maybe {description}; a demonstration with {source}, {target} and maybe {description}."""

    system: str
    prompt: str
    example: str
    answer_start: str = ANSWER_START
    answer_end: str = ANSWER_END


_TASK = "You correct the grammar and spelling of sentences and change as little as you can."
_SHOT = f"Sentence: {{source}}\n{ANSWER_START}{{target}}{ANSWER_END}\n\n"
_HINT = f"Sentence: {{source}}\n{{description}}\n{ANSWER_START}{{target}}{ANSWER_END}\n\n"
_ASK = f"{{examples}}Sentence: {{source}}\n{ANSWER_START}"
#: Templates by name; the wording is this library's own.
TEMPLATES = {
    "zero_shot": Template(_TASK, f"Correct the sentence.\nSentence: {{source}}\n{ANSWER_START}", _SHOT),
    "few_shot": Template(_TASK, "Correct the last sentence as the ones before it were corrected.\n\n" + _ASK, _SHOT),
    "min_edit": Template(_TASK, "Make only the edits that are needed.\n\n" + _ASK, _SHOT),
    "hinted": Template(_TASK, f"Correct the last sentence; the notes may help.\n\n{{examples}}Sentence: {{source}}\n{{description}}\n{ANSWER_START}", _HINT),
    "explained": Template(_TASK, f"Correct the sentence and say why.\n\n{{examples}}Sentence: {{source}}\n{ANSWER_START}", _HINT),
    "plain": Template("", "{source}", "{source}\n{target}\n", "", ""),
    "tokens": Template(_TASK, "Tokens are parted by blanks; keep it so.\n\n" + _ASK, _SHOT),
}


def _filled(pattern: str, **parts: Column) -> Column:
    """A text with {names} as a concatenation of columns."""
    out, rest = [], pattern
    while rest:
        at = min(((i, n) for n in parts if (i := rest.find(f"{{{n}}}")) >= 0), default=None)
        if at is None:
            out.append(F.lit(rest))
            break
        out += [F.lit(rest[: at[0]]), parts[at[1]]]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*out) if out else F.lit("")


def reading_prompt(source: Column, target: Column, examples: str = "") -> Column:
    """The text whose hidden states are read at the target's tokens."""
    return F.concat(F.lit(examples + "Sentence: "), source, F.lit("\nCorrection: "), target)


def prompt(template: Template, examples: Column, source: Column, description: Column | None = None, prefill: bool = False) -> Column:
    """examples: array<struct<text, label, description?>>. The answer's opening tag at the end stays only where it is prefilled."""
    about = description if description is not None else F.lit("")
    shots = F.array_join(F.transform(examples, lambda e: _filled(template.example, source=e["text"], target=e["label"], description=F.trim(e["description"]) if "{description}" in template.example else F.lit(""))), "")
    out = _filled(template.prompt, examples=shots, source=source, description=about)
    if prefill or not template.answer_start:
        return out
    tag = template.answer_start
    return F.when(F.rtrim(out).endswith(tag), F.rtrim(F.left(F.rtrim(out), F.length(F.rtrim(out)) - len(tag)))).otherwise(out)


def messages(template: Template, text: Column, system_role: bool = True) -> Column:
    """Chat form: array<struct<role, content>>; without a system role the system text goes before the user's."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    if system_role:
        return F.array(one("system", F.lit(template.system)), one("user", text))
    return F.array(one("user", F.trim(F.concat(F.lit(template.system + "\n"), text))))


def flat(template: Template, text: Column) -> Column:
    return F.trim(F.concat(F.lit(template.system + "\n"), text))


def template_answer(template: Template, output: Column) -> Column:
    return between_tags(output, template.answer_start, template.answer_end) if template.answer_start else output


def islands(rows: DataFrame, text: str, order: str, *keys: str) -> DataFrame:
    """rows with `island`: runs of adjacent rows of one text share a number, so that a model reads the text once."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((~F.col(text).eqNullSafe(F.lag(text).over(w))).cast("int"), F.lit(1))
    new = F.when(F.row_number().over(w) == 1, 1).otherwise(new)
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w)).drop("__new")


def prompt_batches(rows: DataFrame, text: str, order: str, position: str, *keys: str) -> DataFrame:
    """(keys, island, text, positions): each run once, with the positions that are read of it, in order."""
    run = islands(rows, text, order, *keys)
    return run.groupBy(*keys, "island").agg(F.first(text).alias(text), F.transform(F.array_sort(F.collect_list(F.struct(order, position))), lambda x: x[position]).alias("positions"))


def stored_examples(table: DataFrame, lang: str) -> DataFrame:
    """The fixed demonstrations of a language (lang, text); an error for a language without any but Chinese."""
    out = table.where(F.col("lang") == lang)
    if lang != "zh" and out.isEmpty():
        raise KeyError(lang)
    return out


def final_prompts(lines: DataFrame, examples: DataFrame, template: Template, hints: DataFrame | None = None, key: str = "line_no", chat: bool = True, system_role: bool = True) -> DataFrame:
    """lines (key, id, text[, label]), examples (key, rank, text, label, key column as description) -> id, text[, label], sentence."""
    own = examples.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "label", F.col("description")))), lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"), x["description"].alias("description"))).alias("examples"))
    out = lines.join(own, key, "left")
    out = out.withColumn("examples", F.coalesce("examples", F.array().cast("array<struct<text:string,label:string,description:string>>")))
    out = out.join(hints, key, "left") if hints is not None else out.withColumn("description", F.lit(""))
    text = prompt(template, F.col("examples"), F.col("text"), F.coalesce("description", F.lit("")))
    sentence = messages(template, text, system_role) if chat else flat(template, text)
    return out.select("id", "text", *(["label"] if "label" in lines.columns else []), sentence.alias("sentence"))
