"""Chat formatting in DataFrame expressions only, with a reversible template and a loss mask.

A conversation's turns are collected as structs, sorted, and adjacent turns of one role merged by an array aggregation.
The template is

    <|im_start|>role \\n text [<|im_sep|> text ...] <|im_end|> \\n     for every run of turns of one role

Inside roles and texts, every ``<``, backslashes, ``|`` gets one backslash more, so that no control string can stand
there, and a role's line breaks and percent signs are percent-coded; :func:`parse` undoes both. The loss mask is a list
of character spans of the formatted string, one for each assistant turn's text, escapes included and markers excluded.

Nulls and odd rows: a null text or role is empty; a null turn comes first; equal turn numbers are ordered by role and
text; repeated rows are turns of their own; rows of a null conversation form one conversation; very long texts are
formatted whole: a conversation is one row, so its turns, and no others, must fit in a task; an empty table gives an empty
result; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def merge_turns(turns: Column) -> Column:
    """Runs ``{role, texts}`` from sorted turns ``{turn, role, text}``."""
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(runs: Column, t: Column) -> Column:
        last = F.element_at(runs, -1)
        joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        fresh = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        return F.when((F.size(runs) > 0) & (last["role"] == t["role"]), F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(joined))).otherwise(F.concat(runs, F.array(fresh)))

    # slice() of an empty array needs a positive length, so the first turn starts the list
    first = F.array(F.struct(turns[0]["role"].alias("role"), F.array(turns[0]["text"]).alias("texts")))
    return F.when(F.size(turns) == 0, empty).otherwise(F.aggregate(F.slice(turns, 2, F.size(turns)), first, add))


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` (``start`` from 0, ``length``, in code points)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    c = c.select("conv_id", merge_turns(F.col("turns")).alias("runs"))
    run = F.transform(
        "runs",
        lambda r: F.struct(
            F.concat(F.lit(START), escape_role(r["role"]), F.lit("\n")).alias("head"),
            F.transform(r["texts"], escape).alias("texts"),
            (r["role"] == F.lit(loss_role)).alias("loss"),
        ),
    )
    c = c.withColumn("runs", run)
    body = F.transform("runs", lambda r: F.concat(r["head"], F.array_join(r["texts"], SEP), F.lit(END)))
    c = c.withColumn("formatted", F.array_join(body, ""))
    # spans: running ends of runs, then of the texts within a run
    zero = F.lit(0).cast("bigint")
    state = F.struct(zero.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def text_span(s: Column, x: Column) -> Column:
        span = F.struct(s["at"].alias("start"), F.length(x).cast("bigint").alias("length"))
        return F.struct((s["at"] + F.length(x) + len(SEP)).alias("at"), F.concat(s["spans"], F.array(span)).alias("spans"))

    def run_spans(s: Column, r: Column) -> Column:
        begin = s["at"] + F.length(r["head"])
        total = F.aggregate(r["texts"], zero, lambda n, x: n + F.length(x)) + len(SEP) * (F.size(r["texts"]) - 1)
        inner = F.aggregate(r["texts"], F.struct(begin.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")), text_span)
        return F.struct((begin + total + len(END)).alias("at"), F.when(r["loss"], F.concat(s["spans"], inner["spans"])).otherwise(s["spans"]).alias("spans"))

    spans = F.aggregate("runs", state, run_spans)["spans"]
    return c.select("conv_id", "formatted", spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns ``{role, text}`` back from a formatted conversation, unescaped."""
    blocks = F.split(formatted, F.lit(r"\Q" + START + r"\E"), F.lit(-1))
    blocks = F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(1)))

    def turns(block: Column) -> Column:
        line = F.locate("\n", block)
        body = block.substr(line + 1, F.length(block) - line - len(END))
        texts = F.split(body, F.lit(r"\Q" + SEP + r"\E"), F.lit(-1))
        role = unescape_role(block.substr(F.lit(1), line - 1))
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
