"""Fill-in-middle: a text is cut in three at two drawn boundaries, and its middle moves to the end.

A text becomes an array of its code points (UTF-32). Each code point has a class; where neighbouring classes
differ lies a boundary, so the boundaries are found at once and the drawn ranks index them. Units are single
code points (each its own class), runs of white or other characters, or lines. The three pieces are sliced
and encoded again; markers part them.

Draws come from the SHA-256 of a seed and the id, so reruns, retried tasks and any partitioning agree.

Defined cases: a null text is an empty one; a null id has an empty decimal; a text that is empty or holds a
marker stays plain, so a marker is never ambiguous; rows with one id are drawn alike; an empty table gives an
empty one; columns of any name are carried along, but for those that are made (replaced, told without case).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and of 100 cut ones so many begin with their suffix.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
SEED = 1
#: Bytes of made texts that leave Python at once.
PART_BYTES = 4 << 20
WHITE = np.array([9, 10, 11, 12, 13, 32], "<u4")
MADE = {"fim_form": "string", "fim_n": "long", "fim_prefix": "long", "fim_middle": "long", "fim_text": "string"}


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """The class of each code point; a unit is a run of one class."""
    if unit == "char":
        return np.arange(len(points))
    if unit == "word":
        return np.isin(points, WHITE)
    if unit == "line":
        return np.cumsum(points == 10) - (points == 10)
    raise ValueError(f"unknown unit: {unit}")


def edges(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the end of the last."""
    of = classes(points, unit)
    inside = np.flatnonzero(of[1:] != of[:-1]) + 1
    return np.concatenate([[0], inside, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def draws(doc_id: int | str | None, seed: int) -> list[int]:
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def transformed(text: str, doc_id: int | str | None, unit: str = "char", seed: int = SEED, cut: int = CUT_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> tuple[str, int, int | None, int | None, str]:
    """form, code points, those of prefix and middle (none if plain), the text in its form."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    one, two, keep, turn = draws(doc_id, seed)
    if not len(points) or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or keep % 100 >= cut:
        return "plain", len(points), None, None, text
    at = edges(points, unit)
    a, b = sorted((int(at[one % len(at)]), int(at[two % len(at)])))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:a], points[a:b], points[b:]))
    if turn % 100 < suffix_first:
        return "spm", len(points), a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return "psm", len(points), a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "char", seed: int = SEED, cut: int = CUT_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """``df`` with fim_form (plain, psm or spm), fim_n (code points), fim_prefix and fim_middle (theirs, null if
    plain) and fim_text. Texts are independent of each other: no shuffle, and a task holds one text's arrays and a
    few megabytes of results."""
    classes(np.zeros(1, "<u4"), unit)

    @F.arrow_udf(", ".join(f"{c} {t}" for c, t in MADE.items()))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def packed(rows: list[tuple]) -> pa.Array:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(MADE))

        for ids, texts in batches:
            some, held = [], 0
            for i, t in zip(ids, texts, strict=True):
                some.append(transformed(t.as_py() or "", i.as_py(), unit, seed, cut, suffix_first))
                held += len(some[-1][4])
                if held >= PART_BYTES:
                    yield packed(some)
                    some, held = [], 0
            yield packed(some)

    names = [c for c in df.columns if c.lower() not in MADE]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    out = df.select(row, run(F.col(doc_id).cast("string"), F.col(text)).alias("made"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], *[F.col("made").getField(c).alias(c) for c in MADE])


def restored(form: Column, text: Column) -> Column:
    """The whole text again, from its form."""
    parts = lambda first, second: rf"(?s)\A{first}(.*?){second}(.*?){MIDDLE}(.*)\z"
    return (
        F.when(form == "psm", F.regexp_replace(text, parts(PREFIX, SUFFIX), "$1$3$2"))
        .when(form == "spm", F.regexp_replace(text, parts(SUFFIX, PREFIX), "$2$3$1"))
        .otherwise(text)
    )


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = fill_in_middle(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix").alias("prefix_chars"), F.col("fim_middle").alias("middle_chars"),
        sha(F.col("fim_text")).alias("output_sha256"), sha(restored(F.col("fim_form"), F.col("fim_text"))).alias("restored_sha256"),
    )
