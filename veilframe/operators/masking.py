"""Masking: each finding in a text becomes <TYPE_MASK>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import let

#: From so many findings on a text is taken apart once, so that each cut costs its own length; with fewer, each is looked up by its place.
TAKEN_APART = 64


def _cut(text: Column, chars: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points; chars: its characters, if it is taken apart."""
    n = F.greatest(end - start, F.lit(0))
    return F.when(F.size(chars) > 0, F.array_join(F.slice(chars, start + 1, n), "")).otherwise(F.substring(text, start + 1, n))


def mask(text: Column, findings: Column) -> Column:
    """text with its findings masked; findings: array of structs with start, end and type (or tag).

    In order of start, and of the array where starts are equal: a finding that ends before what is masked already is skipped; what
    stands between two masks is kept, a space is put where nothing does; equal values get the mask of the first of them. A null text
    stays null, and null findings are none.
    """

    def ordered(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda x, i: F.struct(x["start"].cast("int").alias("start"), i.alias("i"), x["end"].cast("int").alias("end"), x["type"].alias("type"))))

    kept_type = "array<struct<before:int,start:int,end:int,type:string>>"
    state = F.expr(f"named_struct('at', 0, 'kept', CAST(array() AS {kept_type}))")

    def step(s: Column, x: Column) -> Column:
        place = F.struct(s["at"].alias("before"), x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"))
        return F.when(x["end"] < s["at"], s).otherwise(F.struct(x["end"].alias("at"), F.concat(s["kept"], F.array(place)).alias("kept")))

    def written(parts: Column) -> Column:
        """parts: kept and chars."""
        kept, chars = parts["kept"], parts["chars"]
        between = lambda x: F.when(_cut(text, chars, x["before"], x["start"]) == "", " ").otherwise(_cut(text, chars, x["before"], x["start"]))
        values = F.transform(kept, lambda x: F.struct(_cut(text, chars, x["start"], x["end"]).alias("value"), between(x).alias("between"), x["type"].alias("type")))

        def joined(v: Column) -> Column:
            of, types = F.transform(v, lambda x: x["value"]), F.transform(v, lambda x: x["type"])
            tokens = F.when(F.size(F.array_distinct(of)) == F.size(v), types).otherwise(F.transform(of, lambda x: F.get(types, (F.array_position(of, x) - 1).cast("int"))))
            return F.array_join(F.zip_with(v, tokens, lambda x, t: F.concat(x["between"], F.lit("<"), t, F.lit("_MASK>"))), "")

        last = F.get(kept, F.size(kept) - 1)["end"]
        return F.concat(let(values, joined), _cut(text, chars, last, F.length(text)))

    def kept_of(spans: Column) -> Column:
        # Where none ends before the one in front of it none is skipped, and no list has to grow.
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
        ends = F.transform(spans, lambda x: x["end"])
        every = F.transform(spans, lambda x, i: F.struct(before(i).alias("before"), x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type")))
        return F.when((ends == F.array_sort(ends)) & (F.get(ends, 0) >= 0), every).otherwise(F.aggregate(spans, state, step, lambda s: s["kept"]))

    kept = let(ordered(findings), kept_of)
    chars = F.when(F.size(findings) >= TAKEN_APART, F.array_remove(F.split(text, ""), "")).otherwise(F.array().cast("array<string>"))
    masked = let(F.struct(kept.alias("kept"), chars.alias("chars")), written)
    return F.when(text.isNull() | (F.coalesce(F.size(findings), F.lit(0)) < 1), text).otherwise(masked).alias("masked")


def mask_spans(text: Column, spans: Column) -> Column:
    """mask() for spans, whose type is their tag."""
    return let(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["tag"].alias("type"))), lambda f: mask(text, f)).alias("masked")
