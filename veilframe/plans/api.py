"""scan(), mask() and detect(): the rule-based and the model branch, merged."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.gibberish import BigramModel
from ..functions.spans import no_spans
from ..functions.text import is_blank, suffix
from ..operators.masking import mask_spans
from ..operators.merging import findings_of, merge_spans, verdict
from ..operators.plugins import plugin_keys
from ..operators.rules import KEY_DETECTORS, KeyDetector, email_spans, home_name_spans, ip_spans, key_spans
from ..operators.windows import Backend, Tokenize, model_spans, spans_of

#: What the rule-based branch can look for.
TAGS = ("EMAIL", "IP_ADDRESS", "KEY", "NAME")


class Settings(NamedTuple):
    """What a scan uses. tags: what the rule-based branch looks for. Without a backend there is no model branch, without a tokenizer words
    are its tokens; first and last are the ids of its boundary tokens. ``Settings(model, **from_folder(path))`` takes all four from a folder."""

    gibberish: BigramModel
    key_detector: KeyDetector = "detect-secrets"
    home_directory: str | None = None
    v6: bool = True
    backend: Backend | None = None
    tokenize: Tokenize | None = None
    window_size: int = 512
    window_overlap: int = 0
    batch_size: int = 1
    first: int = 0
    last: int = 0
    tags: tuple[str, ...] = TAGS


def rule_findings(text: Column, settings: Settings, file_suffix: Column | None = None) -> Column:
    """The rule-based spans of a text, without private addresses and public resolvers."""
    if settings.key_detector not in KEY_DETECTORS:
        raise ValueError(f"key_detector must be one of {KEY_DETECTORS}, not {settings.key_detector!r}")
    if unknown := set(settings.tags) - set(TAGS):
        raise ValueError(f"tags must be of {TAGS}, not {sorted(unknown)}")
    detectors = {
        "EMAIL": lambda: email_spans(text),
        "IP_ADDRESS": lambda: ip_spans(text, public_only=True, v6=settings.v6),
        "KEY": lambda: key_spans(text, settings.gibberish) if settings.key_detector == "regex" else plugin_keys(text, settings.gibberish, file_suffix),
        "NAME": lambda: home_name_spans(text, settings.home_directory),
    }
    return F.concat(no_spans(), *(detectors[tag]() for tag in TAGS if tag in settings.tags))


def with_spans(texts: DataFrame, settings: Settings) -> DataFrame:
    """texts (doc_id, segment_no, filename, text) with spans: the findings of both branches, in order of start, end and tag. Blank texts have none.

    Both branches are projections over a text where it lies; nothing is shuffled.
    """
    found = F.when(is_blank(F.col("text")), no_spans()).otherwise(rule_findings(F.col("text"), settings, suffix(F.col("filename"))))
    if settings.backend is None:
        return texts.withColumn("spans", merge_spans(found))
    both = model_spans(texts, settings.backend, settings.gibberish, settings.tokenize, settings.window_size, settings.window_overlap, settings.batch_size, settings.first, settings.last)
    entities = F.when(is_blank(F.col("text")), no_spans()).otherwise(spans_of(F.col("entities")))
    return both.withColumn("spans", merge_spans(found, entities)).drop("entities")


def scan(texts: DataFrame, settings: Settings) -> DataFrame:
    """One row a finding: doc_id, segment_no, filename, start, end, type, text."""
    return findings_of(with_spans(texts, settings))


def mask(texts: DataFrame, settings: Settings) -> DataFrame:
    """texts with the column masked: text with each finding as <TYPE_MASK>."""
    return with_spans(texts, settings).withColumn("masked", mask_spans(F.col("text"), F.col("spans"))).drop("spans")


def detect(texts: DataFrame, settings: Settings, answers: DataFrame | None = None) -> DataFrame:
    """One row: how many findings stand (after a review's answers, if given), and the exit code."""
    return verdict(scan(texts, settings), answers)


__all__ = ["TAGS", "Settings", "detect", "filters", "mask", "rule_findings", "scan", "with_spans"]
