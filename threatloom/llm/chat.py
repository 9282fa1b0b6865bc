"""Chat formatting with Spark expressions only, reversible, with a loss mask."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template: block of one role, its text, next turn of the same block, end of block.
START, TEXT, NEXT, END = "<|turn|>", "<|says|>", "<|and|>", "<|end|>"
_NAMES = "turn|says|and|end"
_RAW = rf"<(\\*)\|({_NAMES})\|>"
_ESCAPED = rf"<\\(\\*)\|({_NAMES})\|>"
TRAINED_ROLE = "assistant"
# Turns that one aggregate walks over: an aggregate copies its arrays at every step, so long conversations go in shares.
SHARE = 256


def escaped(text: Column) -> Column:
    """Every control string in a text, with any number of backslashes behind its ``<``, gets one backslash more."""
    return F.regexp_replace(text, _RAW, r"<\\$1|$2|>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1|$2|>")


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
              trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans`` (``start``, ``length`` in characters of ``formatted``).

    Turns are collected as structs, sorted (by turn, ties by role, then text; null turns first), and merged: neighbouring turns
    of one role share a block ``<|turn|>role<|says|>text<|and|>text<|end|>``.  The loss spans cover the texts of
    ``trained_role``, one span per turn, never the marks.  Null roles and texts count as empty.  Rows without a conversation
    id form one conversation.  Repeated rows are turns of their own.  A conversation is one output string, so it is
    gathered in one task by definition; whole conversations spread by their id.  Other columns are ignored.
    """
    said = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    talks = turns.select(F.col(conv_col).alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    spans = "array<struct<start:bigint,length:bigint>>"

    def start(role: Column) -> Column:
        return F.struct(
            role.alias("role"), F.array().cast("array<string>").alias("pieces"), F.lit(0).cast("bigint").alias("at"), F.array().cast(spans).alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        opening = F.when(acc.role == x.role, F.lit(NEXT)).otherwise(
            F.concat(F.when(acc.role.isNull(), F.lit("")).otherwise(F.lit(END)), F.lit(START), escaped(x.role), F.lit(TEXT)))
        text = escaped(x.text)
        begin = acc.at + F.length(opening)
        size = F.length(text).cast("bigint")
        span = F.array(F.struct(begin.cast("bigint").alias("start"), size.alias("length")))
        return F.struct(
            x.role.alias("role"), F.concat(acc.pieces, F.array(opening, text)).alias("pieces"), (begin + size).cast("bigint").alias("at"),
            F.when(x.role == trained_role, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    # A share starts with the role of the turn before it; its spans count from its own start and are moved by the lengths before.
    share = lambda c: F.aggregate(
        F.slice("turns", c * SHARE + 1, SHARE), start(F.when(c > 0, F.get("turns", c * SHARE - 1).role)), add)
    last = F.floor((F.size("turns") - 1) / SHARE).cast("int")
    done = talks.select("conv_id", F.transform(F.sequence(F.lit(0), last), share).alias("shares"))
    begins = F.aggregate("shares", F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
    done = done.withColumn("begins", begins)
    moved = F.flatten(F.transform("shares", lambda x, c: F.transform(
        x.spans, lambda s: F.struct((s.start + F.get("begins", c)).alias("start"), s.length.alias("length")))))
    pieces = F.flatten(F.transform("shares", lambda x: x.pieces))
    return done.select("conv_id", F.concat(F.concat_ws("", pieces), F.lit(END)).alias("formatted"), moved.alias("loss_spans"))


def read_turns(text: Column) -> Column:
    """Turns read back from a formatted conversation, as an array of ``role, text``."""
    blocks = F.slice(F.split(text, re.escape(START)), 2, 1 << 30)

    def turns_of(block: Column) -> Column:
        role = F.element_at(F.split(block, re.escape(TEXT)), 1)
        body = F.element_at(F.split(block, re.escape(TEXT)), 2)
        body = F.substring(body, F.lit(1), F.length(body) - len(END))
        return F.transform(F.split(body, re.escape(NEXT)), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask.  Finding a character walks from the start of the string, so a share of the spans is cut out first."""
    def of_share(c: Column) -> Column:
        some = F.slice(spans, c * SHARE + 1, SHARE)
        first, last = F.element_at(some, 1), F.element_at(some, -1)
        part = F.substring(text, (first.start + 1).cast("int"), (last.start + last.length - first.start).cast("int"))
        # One-element arrays bind the cut part and its place, so that they are made once.
        return F.concat_ws("", F.flatten(F.transform(F.array(F.struct(part.alias("text"), first.start.alias("at"))), lambda p: F.transform(
            some, lambda s: unescaped(F.substring(p.text, (s.start - p["at"] + 1).cast("int"), s.length.cast("int")))))))

    shares = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / SHARE).cast("int"))
    return F.when(F.size(spans) > 0, F.concat_ws("", F.transform(shares, of_share))).otherwise("")
