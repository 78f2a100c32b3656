"""Merging the findings of both branches, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import in_order, let

KEYS = ["doc_id", "segment_no"]


def merge_spans(*branches: Column) -> Column:
    """The spans of all branches of one text, each (start, end, tag) once, in that order. A null branch has none."""
    every = F.concat(*(F.coalesce(b, F.expr("CAST(array() AS array<struct<tag:string,value:string,start:int,end:int>>)")) for b in branches))

    def first_of_equals(s: Column) -> Column:
        before = lambda i: F.get(s, i - 1)
        return F.filter(s, lambda x, i: (i == 0) | (x["start"] != before(i)["start"]) | (x["end"] != before(i)["end"]) | (x["tag"] != before(i)["tag"]))

    return let(in_order(every), first_of_equals)


def merge_findings(rules: DataFrame, model: DataFrame) -> DataFrame:
    """merge_spans for findings in rows (doc_id, segment_no, tag, value, start, end): of equal ones the rule-based stays."""
    columns = [*KEYS, "tag", "value", "start", "end"]
    both = rules.select(*columns, F.lit(0).alias("branch")).unionByName(model.select(*columns, F.lit(1).alias("branch")))
    first = Window.partitionBy(*KEYS, "start", "end", "tag").orderBy("branch", "value")
    return both.withColumn("n", F.row_number().over(first)).filter("n = 1").select(*columns)


def findings_of(df: DataFrame, spans: str = "spans") -> DataFrame:
    """A row for each span of df (doc_id, segment_no, filename, spans): filename, start, end, type and text of a finding."""
    # Outer: for a plain explode Catalyst would add filters that repeat the whole expression of the spans.
    rows = df.select(*KEYS, "filename", F.explode_outer(spans).alias("x")).filter("x IS NOT NULL")
    return rows.select(*KEYS, "filename", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.tag").alias("type"), F.col("x.value").alias("text"))


def report_lines(findings: DataFrame) -> DataFrame:
    """line: ``filename: type: text``, newlines in the text shown as \\n."""
    return findings.select(*KEYS, "start", "end", F.concat_ws(": ", "filename", "type", F.replace("text", F.lit("\n"), F.lit("\\n"))).alias("line"))


def unreviewed(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """The findings that no answer (doc_id, segment_no, start, end, type, answer) calls a false positive: n or no, in any case, with white space around it."""
    rejected = answers.filter(F.lower(F.regexp_replace("answer", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).isin("n", "no"))
    return findings.join(rejected.select(*KEYS, "start", "end", "type").distinct(), [*KEYS, "start", "end", "type"], "left_anti")


def verdict(findings: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One row: n_findings that stand, and exit_code, 1 if there are any."""
    left = findings if answers is None else unreviewed(findings, answers)
    return left.agg(F.count(F.lit(1)).alias("n_findings")).withColumn("exit_code", F.least("n_findings", F.lit(1)).cast("int"))
