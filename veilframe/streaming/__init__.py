"""Scans of streams. Either branch works on one row, so no state and no watermark are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.api import Settings, mask, scan


def scan_stream(texts: DataFrame, settings: Settings) -> DataFrame:
    """scan() of a stream of whole texts."""
    return scan(texts, settings)


def mask_stream(texts: DataFrame, settings: Settings) -> DataFrame:
    """mask() of a stream of whole texts."""
    return mask(texts, settings)
