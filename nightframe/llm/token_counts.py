"""Token counts of fields and sections by offset mapping (operator 7).

A whole document is encoded once; each token's character span then meets the
section spans in an interval join of two sorted lists, and a token that crosses
a boundary goes where an explicit rule says:

* ``majority``: to the section that holds most of its characters, the first of equals;
* ``first``: to the section of its first character;
* ``share``: to every section it touches, in proportion to its characters.

Sections are the lines of a text, each with its line feed; ``fields`` joins
several columns by a line feed and takes each column as one section. Offsets
count characters; a character that several tokens share belongs to the token
with its first byte, as a token's share of characters would else be unclear.

Nulls and empty texts have one empty section and no tokens; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import coder
from .textbytes import runs, slices

RULES = ("majority", "first", "share")


def section_bounds(data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray | None = None):
    """(section starts with the end of the data, first section of each row); ``sizes``: bytes of each row's fields."""
    if sizes is not None:
        ends = np.cumsum(sizes + 1, axis=1)[:, :-1]
        starts = offsets[:-1, None] + np.append(np.zeros((len(sizes), 1), np.int64), ends, 1)
        return np.append(starts.ravel(), len(data)), np.arange(len(sizes)) * sizes.shape[1]
    inner = np.setdiff1d(np.flatnonzero(data == 0x0A) + 1, offsets)
    starts = np.sort(np.concatenate([offsets[:-1], inner]), kind="stable")
    return np.append(starts, len(data)), np.searchsorted(starts, offsets[:-1], "left") + runs_of_equal(offsets[:-1])


def runs_of_equal(x: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal values."""
    if not len(x):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return runs(np.diff(np.append(new, len(x))))


def allocate(token_ends: np.ndarray, char_at: np.ndarray, bounds: np.ndarray, rule: str):
    """(tokens of each section, number of sections each token touches).

    ``token_ends``: byte ends of tokens that tile the data; ``char_at``: characters before each byte offset.
    """
    begin, end = char_at[np.append(0, token_ends[:-1])], char_at[token_ends]
    limit = char_at[bounds]
    n = len(bounds) - 1
    first = np.searchsorted(limit, begin, "right") - 1
    first = np.minimum(first, n - 1)
    last = np.maximum(first, np.searchsorted(limit, end, "left") - 1)
    out = np.zeros(n)
    whole = (first == last) | (rule == "first")
    np.add.at(out, first[whole], 1.0) if whole.any() else None
    touched = last - first + 1
    if (cross := np.flatnonzero(~whole)).size:
        token = np.repeat(cross, touched[cross])
        section = first[token] + runs(touched[cross])
        part = np.minimum(end[token], limit[section + 1]) - np.maximum(begin[token], limit[section])
        if rule == "share":
            np.add.at(out, section, part / (end - begin)[token])
        else:
            order = np.lexsort((section, -part, token))
            best = order[np.append(True, token[order][1:] != token[order][:-1])]
            np.add.at(out, section[best], 1.0)
    return out, touched


def section_tokens(df: DataFrame, path: str, rule: str = "majority", key: str = "doc_id", text: str = "text", fields: list[str] | None = None) -> DataFrame:
    """(key, n_tokens, n_sections, n_crossing, section_tokens array<double>) of every row."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    kind = df.schema[key].dataType.simpleString()
    if fields:
        sizes = F.array(*(F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long") for c in fields))
        df = df.select(key, F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in fields)).alias("text"), sizes.alias("sizes"))
        text, columns = "text", [key, "text", "sizes"]
    else:
        columns = [key, text]

    def run(batches):
        bpe = coder(path)
        for batch, data, offsets in slices(batches, text):
            sizes = np.array(batch.column("sizes").to_pylist(), np.int64) if fields else None
            ids, at = bpe.encode(data, offsets)
            ends = np.cumsum(bpe.widths[ids])
            char_at = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            bounds, head = section_bounds(data, offsets, sizes)
            tokens, touched = allocate(ends, char_at, bounds, rule) if len(ids) else (np.zeros(len(bounds) - 1), np.zeros(0, np.int64))
            head = np.append(head, len(tokens))
            crossing = np.append(0, np.cumsum(touched > 1))[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(np.diff(at)), pa.array(np.diff(head)), pa.array(np.diff(crossing)), pa.ListArray.from_arrays(pa.array(head, pa.int32()), pa.array(tokens))],
                [key, "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )

    return df.select(*columns).mapInArrow(run, f"{key} {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")
