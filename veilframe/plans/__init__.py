"""Whole plans: scan and mask."""

from .api import Settings, detect, mask, scan

__all__ = ["Settings", "detect", "mask", "scan"]
