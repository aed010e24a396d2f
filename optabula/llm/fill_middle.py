"""Fill-in-middle: texts cut at two drawn boundaries and put into another order behind marks.

The ends of a text's units, as offsets into its UTF-8 bytes, form a compressed boundary set (see
`boundaries`): a cut after k units is one `select`. Units are words with the white space before
them, or single characters. The draws depend on the seed and the document's id only, so a lost
task draws the same again. Texts pass through Arrow batches that are cut by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boundaries import BoundarySet
from .common import WHITE, text_key, texts

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Bytes of text that leave a task in one batch.
BATCH_BYTES = 4 << 20

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE.encode())] = True


class Rates(NamedTuple):
    """Out of 100: texts that are cut, and cut texts whose suffix comes first."""

    cut: int = 50
    suffix_first: int = 80


def word_ends(data: bytes) -> np.ndarray:
    """Offsets after each word; white space behind the last word is a unit of its own."""
    if not data:
        return np.zeros(0, np.int64)
    white = _IS_WHITE[np.frombuffer(data, np.uint8)]
    ends = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    return np.r_[ends, len(data)] if white[-1] else ends


def character_ends(data: bytes) -> np.ndarray:
    """Offsets after each code point."""
    first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.r_[np.flatnonzero(first)[1:], len(data)] if data else np.zeros(0, np.int64)


UNITS = {"word": word_ends, "character": character_ends}


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4)]


def _characters(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def transformed(doc_id: int | None, text: str, seed: int, rates: Rates, unit: str) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    data = text.encode()
    ends = BoundarySet(UNITS[unit](data))
    n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
    if not text or h3 % 100 >= rates.cut or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = (ends.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (part.decode() for part in (data[:first], data[first:second], data[second:]))
    if h4 % 100 < rates.suffix_first:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, _characters(data[:first]), _characters(data[first:second]), output


def fill_in_middle(docs: DataFrame, seed: int = 42, rates: Rates = Rates(),
                   unit: str = "word") -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, n, form, prefix_chars, middle_chars, output.

    `n` counts units. Of the four draws of a document, two give the cuts, between 0 and n units
    from the start, one decides whether the text is cut and one the order of the parts. A null or
    empty text, and one that holds a mark, stays plain, with null counts of characters. A null
    doc_id draws as the word "null"; rows of one doc_id draw alike and return each; an empty table
    gives no rows; other columns are ignored.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "text_key", "n", "form", "prefix_chars", "middle_chars", "output"]

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows, held = [], 0
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(k) for k in range(3))):
                doc_id, text = doc_id.as_py(), text.as_py()
                rows.append((doc_id, key.as_py(), *transformed(doc_id, text, seed, rates, unit)))
                held += len(text)
                if held > BATCH_BYTES:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    return texts(docs).select("doc_id", text_key(), "text").mapInArrow(
        run, "doc_id long, text_key long, n long, form string, prefix_chars long, "
             "middle_chars long, output string")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that was cut, from the output and its form alone.

    A text that holds a mark is never cut, so the marks of an output part it without doubt.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
            .otherwise(output))
