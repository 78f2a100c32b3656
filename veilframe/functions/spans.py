"""Spans of text: arrays of structs (tag, value, start, end), offsets in code points from 0, end exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Noncharacters that mark the edges of a finding; where a text has them, others stand in for them while it is searched.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
#: Pieces of a text that are gone through at a time, at least; an even number, as every second piece is a finding.
BLOCK = 16
SPAN = "struct<tag:string,value:string,start:int,end:int>"
NONE = f"CAST(array() AS array<{SPAN}>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def no_spans() -> Column:
    return F.expr(NONE)


def span(tag: Column | str, value: Column, start: Column, end: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.struct(tag.alias("tag"), value.alias("value"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _alternate(pieces: Column, text: Column, tag: str) -> Column:
    """The spans of every second piece of text, from the second on.

    Pieces are gone through in blocks: a list that grows is copied at each step, so its length must stay small.
    """

    def at_odd(block: Column, base: Column, value: Callable[[Column, Column], Column]) -> Column:
        def step(s: Column, piece: Column) -> Column:
            until = s["at"] + F.length(piece)
            found = F.when(s["odd"], F.concat(s["found"], F.array(span(tag, value(s["at"], piece), s["at"], until)))).otherwise(s["found"])
            return F.struct(until.alias("at"), (~s["odd"]).alias("odd"), found.alias("found"))

        state = F.struct(base.alias("at"), F.lit(False).alias("odd"), no_spans().alias("found"))
        return F.aggregate(block, state, step, lambda s: s["found"])

    def all_blocks(pieces: Column, value: Callable[[Column, Column], Column]) -> Column:
        # About as many blocks as pieces in one, so that neither grows fast.
        size = F.greatest(F.floor(F.sqrt(F.size(pieces)) / 4) * 2, F.lit(BLOCK)).cast("int")
        blocks = let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / n).cast("int")), lambda k: F.slice(pieces, k * n + 1, n)))

        def placed(blocks: Column) -> Column:
            lengths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, piece: n + F.length(piece)))
            bases = let(lengths, lambda n: F.transform(n, lambda _, k: F.aggregate(F.slice(n, 1, k), F.lit(0), lambda a, x: a + x)))
            return F.flatten(F.zip_with(blocks, bases, lambda block, base: at_odd(block, base, value)))

        return F.when(F.size(pieces) <= BLOCK, at_odd(pieces, F.lit(0), value)).otherwise(let(blocks, placed))

    # A piece is the value itself, unless the text holds the noncharacters: looking it up by its place takes longer the later it stands.
    marked = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    by_place = all_blocks(pieces, lambda at, piece: F.substring(text, at + 1, F.length(piece)))
    return F.when(marked, by_place).otherwise(all_blocks(pieces, lambda at, piece: piece))


def extract(text: Column, pattern: str, tag: str) -> Column:
    """Spans of the second group in all non-overlapping matches of pattern (see patterns); none for a null text."""
    searched = F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")
    marked = F.regexp_replace(searched, pattern, f"$1{OPEN}$2{CLOSE}$3")
    pieces = F.split(marked, f"[{OPEN}{CLOSE}]", -1)
    return F.when(text.isNull(), no_spans()).otherwise(let(pieces, lambda p: F.when(F.size(p) == 1, no_spans()).otherwise(_alternate(p, text, tag))))


def occurrences(text: Column, value: Column, tag: str = "KEY") -> Column:
    """Spans of all non-overlapping occurrences of a literal value; none for an empty or null one."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    in_turn = F.flatten(F.transform(F.split(text, quoted, -1), lambda piece: F.array(piece, value)))
    found = let(in_turn, lambda p: _alternate(F.slice(p, 1, F.size(p) - 1), text, tag))
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, no_spans()).when(~F.contains(text, value), no_spans()).otherwise(F.coalesce(found, no_spans()))


def in_order(spans: Column) -> Column:
    """Sorted by start, end and tag."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["tag"].alias("tag"), x["value"].alias("value"))))
    return F.transform(keyed, lambda x: span(x["tag"], x["value"], x["start"], x["end"]))
