"""Document fingerprints by consistent weighted sampling.

A text is the bag of its words, weighted by their counts. For each of ``SAMPLES`` slots and each word,
fixed random numbers are drawn from the word's hash: r and c from Gamma(2, 1), b from [0, 1). With
weight S, t = floor(ln S / r + b), ln y = r (t - b), ln a = ln c - ln y - r, and the slot holds the
word with the least a, with its t. Two texts agree in a slot with the probability of their generalised
Jaccard similarity, sum of the lesser by sum of the greater weights.

Each document is also compared with an edited text (its end replaced by the beginning of the next
document) and with the next document. For that, documents are placed in ascending order of doc_id:
ids alone give the bounds, whole texts move once, and the first document of a partition also goes to
the partition before it, as what follows its last one.

Defined cases: a null text is an empty one; empty texts (or texts without words) have a fingerprint of
zeros, alike only to each other; rows with one id are ordered by their text; a null id comes first; the
only document is its own next; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SAMPLES = 128
TERMS_KEPT = 120_000
TERMS_LEFT = 40_000
WHOLE_KEPT = 20_000
#: Words whose numbers are drawn at once.
AT_ONCE = 64
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: What Python's split() also cuts at, beside the six characters of the words' definition.
_OTHER_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[1]
    x ^= x >> np.uint64(27)
    x *= _MIX[2]
    x ^= x >> np.uint64(31)
    return x


class Sampler:
    """Keeps the random numbers of words met; what is kept is bounded and changes no result. Of each word there is what
    it needs where its weight is 1 (``once``), and r, c and b of those that were met with more. Where it is full, the
    ``TERMS_LEFT`` words that were met most often stay."""

    def __init__(self, samples: int = SAMPLES) -> None:
        self.k = samples
        self.place: dict[str, int] = {}
        self.hash, self.uses = np.empty(TERMS_KEPT, np.uint64), np.zeros(TERMS_KEPT, np.int64)
        self.once = np.empty((TERMS_KEPT, samples), np.float32)
        self.whole_at, self.wholes = np.full(TERMS_KEPT, -1), 0
        self.whole = np.empty((WHOLE_KEPT, 3, samples), np.float32)
        self.seeds = _mixed(np.arange(1, 3 * samples + 1, dtype=np.uint64) * _MIX[0])

    def _drawn(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, c, b of words by their hashes: from the low and the high half of each number, one after the other, in (0, 1)."""
        k = self.k
        drawn = _mixed(h[:, None] ^ self.seeds[None, :]).view("<u4").astype(np.float32)
        drawn += np.float32(0.5)
        drawn *= np.float32(2**-32)
        logs = np.log(drawn[:, : 4 * k])
        np.negative(logs, out=logs)
        gamma = logs[:, ::2] + logs[:, 1::2]
        return gamma[:, :k], np.log(gamma[:, k:]), np.minimum(drawn[:, 4 * k :: 2], np.float32(0.9999999))

    def _add(self, new: list[str]) -> None:
        at = len(self.place)
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64)
        for i in range(0, len(new), AT_ONCE):
            r, c, b = self._drawn(h[i : i + AT_ONCE])
            self.once[at + i : at + i + len(r)] = c + r * b - r
        to = slice(at, at + len(new))
        self.hash[to], self.uses[to], self.whole_at[to] = h, 0, -1
        self.place.update(zip(new, range(at, at + len(new)), strict=True))

    def _wholes(self, at: np.ndarray) -> np.ndarray:
        """r, c, b of the words at these places, kept for the next time."""
        missing = at[self.whole_at[at] < 0]
        if len(missing):
            if self.wholes + len(missing) > WHOLE_KEPT:
                self.whole_at[:], self.wholes, missing = -1, 0, at
            if len(missing) > WHOLE_KEPT:
                return np.concatenate([np.stack(self._drawn(self.hash[at[i : i + AT_ONCE]]), 1) for i in range(0, len(at), AT_ONCE)])
            for i in range(0, len(missing), AT_ONCE):
                some = missing[i : i + AT_ONCE]
                to = np.arange(self.wholes, self.wholes + len(some))
                self.whole[to[0] : to[-1] + 1] = np.stack(self._drawn(self.hash[some]), 1)
                self.whole_at[some], self.wholes = to, self.wholes + len(some)
        return self.whole[self.whole_at[at]]

    def _forget(self, left: int) -> None:
        """Keeps the ``left`` words that were met most often; uses are halved, so what was met long ago goes."""
        names, n = list(self.place), len(self.place)
        stay = np.sort(np.argpartition(-self.uses[:n], left)[:left]) if 0 < left < n else np.arange(min(left, n))
        for of in (self.hash, self.uses, self.once, self.whole_at):
            of[: len(stay)] = of[stay]
        self.uses[: len(stay)] //= 2
        self.place = {names[i]: k for k, i in enumerate(stay.tolist())}

    def signature(self, text: str) -> np.ndarray:
        """One 32-bit number a slot, from the slot's word and t."""
        count = Counter(_words(text))
        if not count:
            return np.zeros(self.k, "<u4")
        if len(count) > TERMS_KEPT:
            return self._large(count)
        at = np.array([self.place.get(w, -1) for w in count])
        new = np.flatnonzero(at < 0)
        if len(new):
            names = list(count)
            if len(self.place) + len(new) > TERMS_KEPT:
                self._forget(min(TERMS_LEFT, TERMS_KEPT - len(count)))
                at = np.array([self.place.get(w, -1) for w in names])
                new = np.flatnonzero(at < 0)
            at[new] = np.arange(len(self.place), len(self.place) + len(new))
            self._add([names[i] for i in new.tolist()])
        self.uses[at] += 1
        return self._least(at, np.fromiter(count.values(), np.int64, len(count)))[1]

    def _least(self, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.once[at]
        many = np.flatnonzero(weight > 1)
        t = np.zeros((len(many), self.k), np.float32)
        if len(many):
            whole = self._wholes(at[many])
            r, c, b = whole[:, 0], whole[:, 1], whole[:, 2]
            t = np.floor(np.log(weight[many].astype(np.float32))[:, None] / r + b)
            a[many] = c - r * (t - b) - r
        best = a.argmin(0)
        slots = np.arange(self.k)
        row = np.full(len(at), -1)
        row[many] = np.arange(len(many))
        row = row[best]
        steps = np.where(row >= 0, t[np.maximum(row, 0), slots] if len(many) else 0, 0).astype(np.int64).astype(np.uint64)
        mark = _mixed(self.hash[at[best]] + steps * _MIX[0] + np.arange(1, self.k + 1, dtype=np.uint64))
        return a[best, slots], (mark >> np.uint64(32)).astype("<u4") | np.uint32(1)

    def _large(self, count: Counter[str]) -> np.ndarray:
        """More different words than are kept: in blocks, keeping each slot's least."""
        names, least, out = list(count), None, None
        for i in range(0, len(names), TERMS_KEPT):
            self.place.clear()
            some = names[i : i + TERMS_KEPT]
            self._add(some)
            a, mark = self._least(np.arange(len(some)), np.array([count[w] for w in some]))
            out, least = (mark, a) if least is None else (np.where(a < least, mark, out), np.minimum(a, least))
        return out


def _words(text: str) -> list[str]:
    """Python's split() where it and the words' definition cut alike, else by the definition."""
    return text.split() if _OTHER_SPACES.search(text) is None else _WORD.findall(text)


@lru_cache(maxsize=2)
def sampler(samples: int) -> Sampler:
    return Sampler(samples)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """``df`` with the fingerprint of each text, in hexadecimal."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own = sampler(samples)
        return texts.map(lambda t: own.signature(t or "").tobytes().hex())

    return df.withColumn(out, run(F.col(text)))


def in_order(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, ahead: partitions in ascending doc_id, each followed by the next one's first row
    (``ahead``), the last by the first of all. Ids alone reach the driver, one for each partition."""
    df = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lowest = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(lowest))
    bounds = np.array(shared.range_bounds(df, "doc_id", shared.ordered_parts(df)), np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right"))

    heads = sorted(df.select(key.alias("k")).groupBy(part("k").alias("p")).agg(F.min("k").alias("k")).toPandas().itertuples(index=False, name=None))
    parts = [int(p) for p, _ in heads]
    before = {int(k): parts[i - 1] for i, (_, k) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def goes_to(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy(np.int64)
        own = np.searchsorted(bounds, ids, "right")
        return pd.Series([[int(p), before[int(k)]] if int(k) in before else [int(p)] for p, k in zip(own, ids, strict=True)])

    df = df.select("doc_id", "text", F.posexplode(goes_to(key)).alias("ahead", "part"))
    df = df.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("ahead", F.col("doc_id").asc_nulls_first(), "text")
    return df.select("doc_id", "text", "ahead")


def against_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, rows = sampler(samples), None, []
        for batch in batches:
            for i, t, ahead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = t or ""
                if ahead and last is None:
                    break
                now = own.signature(t)
                if last is not None:
                    was_id, was, was_mark = last
                    changed = edited(was, t)
                    mark = was_mark if changed == was else own.signature(changed)
                    rows.append((was_id, len(was), sha256(changed.encode()).hexdigest(), was_mark.tobytes().hex(), mark.tobytes().hex(), likeness(was_mark, mark), likeness(was_mark, now)))
                last = None if ahead else (i, t, now)
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    return in_order(df, doc_id, text).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
