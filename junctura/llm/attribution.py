"""Token counts by section, from one encoding of the whole document.

A document is encoded once, so tokens are those that a model sees. Each token's span of characters (of
its bytes; a character cut by a token border belongs to both tokens) is joined with the sections' spans
by binary search on their starts. Sections are the document's lines, each with its line feed, or spans of
fields that were put together. A token that crosses a border goes to the section that holds most of
its characters, the earlier one of equals; it is counted there only, so the sections' counts add up to
the document's.

Defined cases: a null or empty text has one section, 0 to 0, without tokens; rows are independent, so
repeated rows and ties need no care; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe, load


def line_starts(text: str) -> np.ndarray:
    """Starts of the lines, the end of the text last."""
    parts = text.split("\n")
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    starts[-1] -= 1
    return starts[:-1] if len(starts) > 2 and starts[-1] == starts[-2] else starts


def token_spans(bpe: ByteBpe, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token."""
    size = bpe.offset[ids.astype(np.int64) + 1] - bpe.offset[ids]
    ends = np.cumsum(size)
    if text.isascii():
        return ends - size, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80)  # the number of characters begun, up to each byte
    return char[ends - size] - 1, char[ends - 1]


def allocate(first: np.ndarray, end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the section of each token, whether it crosses a border)."""
    inner = starts[1:-1]
    low, high = np.searchsorted(inner, first, "right"), np.searchsorted(inner, end - 1, "right")
    crosses = low != high
    for k in np.flatnonzero(crosses):
        edges = np.concatenate([[first[k]], starts[low[k] + 1 : high[k] + 1], [end[k]]])
        low[k] += int(np.diff(edges).argmax())
    return low, crosses


def by_section(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, section, start, stop, n_tokens, n_crossing (tokens given to the section that cross its borders)."""
    names = ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            which, columns = [], [[], [], [], [], []]
            for i, (t, packed) in enumerate(zip(texts, bpe.batches(texts), strict=True)):
                ids = np.frombuffer(packed, "<u4")
                starts = line_starts(t)
                n = len(starts) - 1
                section, crosses = allocate(*token_spans(bpe, t, ids), starts)
                which.append(np.full(n, i))
                for column, values in zip(columns, (np.arange(n), starts[:-1], starts[1:], np.bincount(section, minlength=n), np.bincount(section[crosses], minlength=n)), strict=True):
                    column.append(values)
            if which:
                out = [batch.column(0).take(pa.array(np.concatenate(which), pa.int64()))]
                yield pa.RecordBatch.from_arrays(out + [pa.array(np.concatenate(c), pa.int64()) for c in columns], names)

    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:])
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
