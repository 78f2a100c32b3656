"""Unified diffs as texts: each run of added lines is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: where str.splitlines() ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def additions(diffs: DataFrame, empty_is_error: bool = True) -> DataFrame:
    """filename, segment_no (from 0) and text of each maximal run of added lines in diffs (filename, diff_text; one row a file).

    Only lines after the first hunk header count; a header and any line that is not added end a run. An empty diff is an error unless
    that is waived. Only the lines of one file are ordered at a time.
    """
    if empty_is_error:
        missing = F.coalesce(F.length("diff_text"), F.lit(0)) == 0
        diffs = diffs.withColumn("diff_text", F.when(missing, F.raise_error(F.concat(F.lit("no added text: "), F.coalesce("filename", F.lit("?"))))).otherwise(F.col("diff_text")))
    lines = diffs.select("filename", F.posexplode(F.split("diff_text", LINE_END, -1)).alias("pos", "line"))
    so_far = Window.partitionBy("filename").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    header = F.startswith("line", F.lit("@@"))
    lines = lines.withColumn("in_hunk", F.max(header).over(so_far))
    added = F.col("in_hunk") & F.startswith("line", F.lit("+"))
    lines = lines.withColumn("added", added).withColumn("run", F.sum((~F.col("added")).cast("int")).over(so_far))
    runs = lines.filter("added").groupBy("filename", "run").agg(F.array_sort(F.collect_list(F.struct("pos", F.expr("substring(line, 2)").alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    number = F.row_number().over(Window.partitionBy("filename").orderBy("run")) - 1
    return runs.select("filename", number.alias("segment_no"), text.alias("text"))
