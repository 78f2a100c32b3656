"""The mask against a fold in Python, and cases by hand."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import masking, merging

SCHEMA = "i int, text string, f array<struct<start:int,end:int,type:string>>"


def masked(spark, cases):
    df = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(cases)], SCHEMA)
    return [r["m"] for r in sorted(df.select("i", masking.mask(F.col("text"), F.col("f")).alias("m")).collect())]


def by_hand(text, findings):
    """An independent statement of the rules: step through the findings in order of start."""
    out, at, known = "", 0, {}
    for start, end, kind in sorted(findings, key=lambda f: f[0]):
        if end >= at:
            gap = text[at:start] if start > at else ""
            token = known.setdefault(text[start:end], f"<{kind}_MASK>")
            out, at = out + (gap or " ") + token, end
    return out + text[at:]


def test_cases(spark):
    text = "图: ANNA\r\nanna@mail.example\tSESAME😀x"
    cases = [
        (text, [(text.index("SESAME"), text.index("SESAME") + 6, "PASSWORD"), (3, 7, "NAME"), (9, 26, "EMAIL")]),
        ("<tag><tag>", [(0, 5, "KEY"), (5, 10, "KEY")]),
        ("before lmnopqrstu after", [(7, 12, "NAME"), (9, 10, "KEY"), (10, 17, "PASSWORD"), (7, 12, "NAME")]),
        ("It is Robin Sample", [(6, 18, "NAME"), (6, 18, "PASSWORD")]),
        ("It is Robin Sample", [(6, 18, "PASSWORD"), (6, 18, "NAME")]),
        ("", []), ("\r\n ", []), ("图 text", None), (None, [(0, 1, "KEY")]),
    ]
    got = masked(spark, cases)
    assert got[0] == "图: <NAME_MASK>\r\n<EMAIL_MASK>\t<PASSWORD_MASK>😀x"
    assert got[1] == " <KEY_MASK> <KEY_MASK>"
    assert got[2] == "before <NAME_MASK> <NAME_MASK> <PASSWORD_MASK> after"
    assert got[3] == "It is <NAME_MASK> <NAME_MASK>" and got[4] == "It is <PASSWORD_MASK> <PASSWORD_MASK>"
    assert got[5:] == ["", "\r\n ", "图 text", None]


def test_random_spans(spark):
    rng, cases = random.Random(1), []
    for _ in range(300):
        text = "".join(rng.choices("ab 😀\n", k=20))
        cases.append((text, [(s := rng.randrange(20), min(20, s + rng.randint(1, 6)), rng.choice(["NAME", "KEY"])) for _ in range(rng.randint(0, 5))]))
    assert masked(spark, cases) == [by_hand(t, f) for t, f in cases]


@pytest.fixture
def branches(spark):
    schema = "doc_id long, segment_no int, tag string, value string, start int, end int"
    a = spark.createDataFrame([(1, 0, "KEY", "x", 4, 5), (1, 0, "EMAIL", "y", 0, 3), (1, 1, "KEY", "x", 4, 5)], schema)
    b = spark.createDataFrame([(1, 0, "KEY", "x", 4, 5), (1, 0, "NAME", "x", 4, 5)], schema)
    return a, b


def test_merge(spark, branches):
    rows = sorted(tuple(r) for r in merging.merge_findings(*branches).select("doc_id", "segment_no", "start", "end", "tag").collect())
    assert rows == [(1, 0, 0, 3, "EMAIL"), (1, 0, 4, 5, "KEY"), (1, 0, 4, 5, "NAME"), (1, 1, 4, 5, "KEY")]
    arrays = [b.groupBy("doc_id", "segment_no").agg(F.collect_list(F.struct("tag", "value", "start", "end")).alias(n)) for n, b in zip("ab", branches)]
    merged = arrays[0].join(arrays[1], ["doc_id", "segment_no"], "left").select("segment_no", merging.merge_spans(F.col("a"), F.col("b")).alias("s")).collect()
    assert [[(x["start"], x["tag"]) for x in r["s"]] for r in sorted(merged)] == [[(0, "EMAIL"), (4, "KEY"), (4, "NAME")], [(4, "KEY")]]


def test_triage_and_report(spark):
    found = spark.createDataFrame([(1, 0, "f", 0, 3, "KEY", "a\nb"), (1, 0, "f", 5, 8, "EMAIL", "c")], "doc_id long, segment_no int, filename string, start int, end int, type string, text string")
    says = lambda *answers: spark.createDataFrame([(1, 0, s, s + 3, t, a) for s, t, a in answers], "doc_id long, segment_no int, start int, end int, type string, answer string")
    verdict = lambda answers=None: tuple(merging.verdict(found, answers).first())
    assert verdict() == (2, 1)
    assert verdict(says((0, "KEY", " No\n"))) == (1, 1)
    assert verdict(says((0, "KEY", "n"), (5, "EMAIL", "NO"), (5, "EMAIL", "no"))) == (0, 0)
    assert verdict(says((0, "KEY", "yes"), (5, "EMAIL", ""))) == (2, 1)
    assert {r["line"] for r in merging.report_lines(found).collect()} == {"f: KEY: a\\nb", "f: EMAIL: c"}
