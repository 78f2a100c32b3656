"""Token counts of sections (operator 9): offset-mapped attribution.

Method: a whole text is encoded once (byte-level BPE, as in byte_bpe). Each token has a span of UTF-8 bytes, each section has
one too, and an interval join of the two sorted lists within the document gives every token to one section by a stated rule:

- ``first``: the section that holds the token's first byte;
- ``last``: the section that holds its last byte;
- ``most``: the section that holds most of its bytes, the earlier one of equals.

Sections tile the text, so each token is given to exactly one section and the sections' counts add up to the document's count.
As default the sections are the lines, each with its newline; ``sections`` may name another Java-free rule, see section_ends.

Defined cases: a null or empty text has one empty section, 0, with no tokens; rows that repeat each give their sections; only
``doc_id`` and ``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import PieceEncoder, encoder
from .common import map_arrow, slices, with_fields

RULES = ("first", "last", "most")


def section_ends(raw: bytes, separator: bytes) -> np.ndarray:
    """The byte after each section; a section ends after each occurrence of separator and at the end of the text."""
    ends, at = [], raw.find(separator)
    while at >= 0:
        ends.append(at + len(separator))
        at = raw.find(separator, ends[-1])
    if not ends or ends[-1] < len(raw):
        ends.append(len(raw))
    return np.array(ends, np.int64)


def attribute(token_bytes: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them reach over its borders. token_bytes: lengths; ends: as section_ends gives."""
    after = np.cumsum(token_bytes)
    first, last = np.searchsorted(ends, after - token_bytes, "right"), np.searchsorted(ends, after - 1, "right")
    if rule == "first":
        to = first
    elif rule == "last":
        to = last
    else:
        to = first.copy()
        for t in np.flatnonzero(first != last):
            edges = np.concatenate([[after[t] - token_bytes[t]], ends[first[t] : last[t]], [after[t]]])
            to[t] = first[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(to, minlength=len(ends)), np.bincount(to[first != last], minlength=len(ends))


def count_sections(docs: DataFrame, ranks_path: str, pattern: str, separator: str = "\n", rule: str = "first") -> DataFrame:
    """doc_id, section_no, n_bytes, n_tokens and n_crossing of every section of every row of docs; see the module."""
    if rule not in RULES or not separator:
        raise ValueError(f"rule must be one of {RULES} and separator not empty")
    mark = separator.encode()
    names = ["doc_id", "section_no", "n_bytes", "n_tokens", "n_crossing"]
    docs = docs.select("doc_id", "text")
    schema = with_fields(docs.select("doc_id"), "section_no long, n_bytes long, n_tokens long, n_crossing long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: PieceEncoder = encoder(ranks_path, pattern)
        lengths = np.fromiter(map(len, bpe.bytes_of), np.int64, len(bpe.bytes_of))
        for batch in batches:
            for part in slices(batch, "text"):
                found: list[list[np.ndarray]] = [[], [], [], []]
                sections = []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    ends = section_ends(text.encode(), mark)
                    tokens, crossing = attribute(lengths[np.array(bpe.encode(text), np.int64)], ends, rule)
                    sections.append(len(ends))
                    for column, values in zip(found, (np.arange(len(ends)), np.diff(ends, prepend=0), tokens, crossing)):
                        column.append(values.astype(np.int64))
                if sections:
                    rows = pa.array(np.repeat(np.arange(len(sections)), sections))
                    yield pa.record_batch([part.column("doc_id").take(rows), *(pa.array(np.concatenate(x)) for x in found)], names=names)

    return map_arrow(docs, run, schema)
