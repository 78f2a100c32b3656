"""Rule-based detectors: columns of spans, one array a text."""

from __future__ import annotations

import os
import re
from typing import Literal

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters, patterns
from ..functions.gibberish import BigramModel
from ..functions.spans import extract, let, no_spans, span
from .plugins import plugin_keys

KeyDetector = Literal["regex", "detect-secrets"]
KEY_DETECTORS = ("regex", "detect-secrets")

# Fixed value: shared accounts, whose names say nothing of a person.
SHARED_ACCOUNTS = (
    "admin", "administrator", "almalinux", "centos", "cloud-user", "debian", "ec2-user", "fedora", "guest", "jenkins",
    "opc", "rocky", "root", "runner", "ubuntu", "user", "vagrant",
)


def email_spans(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), extract(text, patterns.EMAIL, "EMAIL")).otherwise(no_spans())


def raw_ip_spans(text: Column) -> Column:
    needed = text.rlike(patterns.IP_NEEDS)
    for part in patterns.IP_NEEDS_ONE_OF:
        needed = needed | F.contains(text, F.lit(part))
    return F.when(needed, extract(text, patterns.IP, "IP_ADDRESS")).otherwise(no_spans())


def ip_spans(text: Column, public_only: bool = False, v6: bool = True) -> Column:
    """IP findings; public_only leaves out private addresses and public resolvers too. v6: whether addresses with a colon are reported."""

    def keep(x: Column) -> Column:
        kept = filters.is_address_finding(text, x, v6)
        return kept & ~filters.excluded_address(x["value"], v6) if public_only else kept

    return let(raw_ip_spans(text), lambda spans: F.filter(spans, keep)).alias("ip_spans")


_FOUND = T.StructType([T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(T.ArrayType(_FOUND))
def _long_key_spans(texts: pd.Series) -> pd.Series:
    pattern = regex.compile(patterns.KEY_PYTHON)
    return texts.map(lambda t: None if t is None else [{"value": m.group(1), "start": m.start(1), "end": m.end(1)} for m in pattern.finditer(t)])


def raw_key_spans(text: Column, long_runs: bool = True) -> Column:
    """Key-shaped spans. Texts with unbroken runs on which Java would recurse too deeply go to Python's regex module; without long_runs they
    have none, and the plan stays within the JVM."""
    needed = text.rlike(patterns.KEY_NEEDS)
    is_long = (F.length(text) >= 1_000) & text.rlike(patterns.LONG_RUN)
    short = extract(text, patterns.KEY_QUICK, "KEY")
    if not long_runs:
        return F.coalesce(F.when(needed & ~is_long, short), no_spans())
    by_python = F.transform(_long_key_spans(F.when(needed & is_long, text)), lambda x: span("KEY", x["value"], x["start"], x["end"]))
    return F.coalesce(F.when(needed, F.when(is_long, by_python).otherwise(short)), no_spans())


def key_spans(text: Column, model: BigramModel, long_runs: bool = True) -> Column:
    return F.filter(raw_key_spans(text, long_runs), lambda x: model.is_gibberish(F.lower(x["value"]))).alias("key_spans")


def home_name_spans(text: Column, home_directory: str | None = None) -> Column:
    """The last component of the home directory, wherever its whole path stands; slashes may be escaped by a backslash."""
    home = os.environ.get("HOME", "") if home_directory is None else home_directory
    folder, slash, name = home.rstrip("/").rpartition("/")
    if not name or name.casefold() in SHARED_ACCOUNTS:
        return no_spans()
    quoted = "".join(r"\\?/" if c == "/" else "\\Q" + c + "\\E" if not c.isalnum() else c for c in folder + slash)
    found = extract(text, rf"({quoted})({re.sub(r'([^A-Za-z0-9])', lambda m: chr(92) + 'Q' + m[1] + chr(92) + 'E', name)})()", "NAME")
    return F.when(F.contains(text, F.lit(name)), found).otherwise(no_spans())


def rule_spans(text: Column, model: BigramModel, key_detector: KeyDetector = "detect-secrets", suffix: Column | None = None, home_directory: str | None = None, v6: bool = True) -> Column:
    """All rule-based findings of a text, before private addresses are left out."""
    if key_detector not in KEY_DETECTORS:
        raise ValueError(f"key_detector must be one of {KEY_DETECTORS}, not {key_detector!r}")
    keys = key_spans(text, model) if key_detector == "regex" else plugin_keys(text, model, suffix)
    return F.concat(email_spans(text), ip_spans(text, v6=v6), keys, home_name_spans(text, home_directory))
