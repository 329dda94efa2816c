"""Similarity join of documents on word shingles, by T-occurrence search.

A document is the set of its distinct shingles of ``words`` words. Two documents link when their Jaccard
similarity reaches ``percent``; both are parameters (``WORDS`` and ``PERCENT``, if not given). The result
gives each document its set's size and the least doc_id that it can reach by links. The search is exact; only the components of the links are kept, not all links.

1. One pass over the texts gives each set's size and 64-bit name (a second hash tells if two sets ever
   share a name; then the search begins anew with another seed) and the ``FREQUENT`` shingles that the
   tasks met most often. Documents with one set are one node from here on.
2. A set of n shingles must share at least T = ``percent`` of n with a partner. As in DivideSkip, its
   L longest inverted lists are set aside; a partner occurs at least T - L times in the rest. "Longest" is
   an order of all shingles: frequent ones last, else by hash. With n - L = n - T + k short lists, partners
   share at least k = ``k_of(n)`` of them. Short lists are merged by shuffling on the shingle (frequent
   ones, which are known to be shared, are dealt out by node as well); a list of one node goes.
3. The same bound is used once more, in the order of the lists' exact lengths: of the c shared lists of a
   node, it must meet a partner in one of the c - k + 1 shortest, with the k of its smallest possible
   partner (a node with fewer than k goes). The nodes of each such list are tied to its least node; a list
   of more than ``LIST`` nodes is dealt into parts that are tied first.
4. Ties make groups of nodes; only within groups are whole sets compared. In a group, for each set,
   short lists are merged, candidates below T - L drop out, the others are probed in the long lists by
   binary search, and those that reach the required overlap link. What is linked already isn't compared
   again. A group of more than ``GROUP`` nodes is dealt into blocks: blocks by themselves first, then a few
   times one node for each component so far, in blocks dealt anew, then every two blocks that aren't of
   one component.
5. Components: within a unit by union-find; what remains between blocks by star steps.

Defined cases: a null text or one without words has no shingles and is its own component; fewer than
``words`` words are one shingle; rows with equal text are one node; rows with one id but different texts
are different nodes of that id; a null doc_id is never a component's name unless there is no other; an
empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected
from . import shared

WORDS = 4
PERCENT = 85
#: Nodes of a list that are tied at once. Lists of more than ``LONG`` times as many aren't measured, but all long.
LIST = 1024
LONG = 64
GROUP = 512
BLOCK = 256
ROUNDS = 3
#: Nodes that a task remembers, so as not to count or give out copies again.
REMEMBERED = 500_000
#: How many of the most frequent shingles are ordered last; this many at most reach the driver from a task.
FREQUENT = 20_000
#: Shingles that a task gathers before it counts them.
COUNTED_AT_ONCE = 1 << 20
BLOCK_BYTES = 1 << 16
#: Shingles that leave Python at once, about.
GIVEN_AT_ONCE = 1 << 18
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of a text's words by one polynomial over its bytes, and of its shingles from those."""

    def __init__(self, seed: int, words: int = WORDS) -> None:
        self.words = words
        self.byte = _mixed(np.arange(256, dtype=np.uint64) * _MIX[0] + np.uint64(seed + 1))
        self.base = int(_mixed(np.array([seed + 77], np.uint64))[0]) & ~7 | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up, self.down = self._powers(self.base, 4096), self._powers(self.inverse, 4096)
        self.space = np.zeros(256, bool)
        self.space[[ord(c) for c in shared.SPACES]] = True

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _words(self, raw: np.ndarray) -> np.ndarray:
        """The hash of each word of some bytes that begin and end between words; it doesn't depend on the place."""
        inside = ~self.space[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        n = len(raw)
        if n >= len(self.up):  # a word that is longer than a block
            self.up, self.down = self._powers(self.base, 2 * n), self._powers(self.inverse, 2 * n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.up[:n], out=total[1:])
        return _mixed((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def shingles(self, text: str) -> np.ndarray:
        """The distinct shingles' hashes, rising. Long texts are hashed in blocks of whole words, so what is held
        besides the text is eight bytes a word, a few times."""
        raw = np.frombuffer(text.encode().lower(), np.uint8)  # bytes are lower-cased in ASCII only
        parts, at = [], 0
        while at < len(raw):
            end, step = at + BLOCK_BYTES, 0
            while end < len(raw) and not step:  # on to the next space
                spaces = np.flatnonzero(self.space[raw[end : end + BLOCK_BYTES]])
                step = len(spaces)
                end += int(spaces[0]) if step else BLOCK_BYTES
            parts.append(self._words(raw[at:end]))
            at = end
        word = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if not len(word):
            return word
        k = min(self.words, len(word))
        out = np.zeros(len(word) - k + 1, np.uint64)
        for i in range(k):
            out = _mixed(out + word[i : len(word) - k + 1 + i])
        return np.unique(out)

    @staticmethod
    def name(shingles: np.ndarray) -> tuple[int, int]:
        """Two independent 64-bit hashes of a set."""
        a = _mixed(shingles + _MIX[0]).sum(dtype=np.uint64) + np.uint64(len(shingles))
        b = _mixed(shingles ^ _MIX[1]).sum(dtype=np.uint64)
        return tuple(int(x) for x in _mixed(np.array([a, b], np.uint64)).view(np.int64))


def t_of(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of a set of n shingles with any partner."""
    return -(-percent * n // 100)


def k_of(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many short lists partners must share: 1 + n - T, and T at most. Never falls as n grows."""
    return np.minimum(1 + n - t_of(n, percent), t_of(n, percent))


def t_column(n: Column, percent: int) -> Column:
    """``t_of`` as a Column."""
    return F.ceil(n * percent / 100)


def k_column(n: Column, percent: int) -> Column:
    """``k_of`` as a Column."""
    return F.least(1 + n - t_column(n, percent), t_column(n, percent))


def prefix_of(n: int, percent: int) -> int:
    """How many lists of a set of n shingles are not set aside."""
    return int(n - t_of(n, percent) + k_of(n, percent)) if n else 0


class Frequent:
    """The ``FREQUENT`` shingles met most often, in bounded memory: those counted so far and the next
    ``COUNTED_AT_ONCE`` are counted together, and the most frequent stay."""

    def __init__(self) -> None:
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.n += len(tokens)
        if self.n >= COUNTED_AT_ONCE:
            self.fold()

    def fold(self) -> None:
        tokens, counts = np.unique(np.concatenate([*self.waiting, np.zeros(0, np.uint64)]), return_counts=True)
        tokens, counts = tokens[counts > 1], counts[counts > 1]
        self.tokens, at = np.unique(np.concatenate([self.tokens, tokens]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, counts]), len(self.tokens)).astype(np.int64)
        if len(self.tokens) > FREQUENT:
            most = np.argpartition(self.counts, -FREQUENT)[-FREQUENT:]
            self.tokens, self.counts = self.tokens[most], self.counts[most]
        self.waiting, self.n = [], 0


def names(df: DataFrame, seed: int, words: int, percent: int) -> DataFrame:
    """kind 0: row of a document (doc_id, n, node, other); kind 1: a frequent shingle (node) and its count (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, often = Shingler(seed, words), Frequent()
        done: set[int] = set()
        for batch in batches:
            n, node, other = [], [], []
            for t in batch.column(1):
                s = own.shingles(t.as_py() or "")
                a, b = own.name(s)
                if a not in done:  # copies count once, as far as they are remembered
                    often.add(s[: prefix_of(len(s), percent)])
                    if len(done) < REMEMBERED:
                        done.add(a)
                n.append(len(s))
                node.append(a)
                other.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(n), pa.int64()), batch.column(0), *(pa.array(v, pa.int64()) for v in (n, node, other))], ["kind", "doc_id", "n", "node", "other"]
            )
        often.fold()
        m = len(often.tokens)
        values = (np.ones(m, np.int64), np.zeros(m, np.int64), often.counts, often.tokens.view(np.int64), np.zeros(m, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], ["kind", "doc_id", "n", "node", "other"])

    return df.mapInArrow(run, "kind long, doc_id long, n long, node long, other long")


def postings(df: DataFrame, seed: int, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """token, node, n, often: the short lists of each node, and whether a list is of a frequent shingle.
    frequent: such shingles, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(seed, words)
        place = np.argsort(frequent)
        known = frequent[place]
        done: set[int] = set()

        def given(parts: list[tuple[np.ndarray, np.ndarray]], sizes: list[tuple[int, int, int]]) -> pa.RecordBatch:
            node, n, times = (np.array(c, np.int64) for c in zip(*sizes, strict=True))
            columns = [np.concatenate([p[0] for p in parts]), np.repeat(node, times), np.repeat(n, times).astype(np.int32), np.concatenate([p[1] for p in parts])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "often"])

        for batch in batches:
            parts, sizes, held = [], [], 0
            for t in batch.column(0):
                s = own.shingles(t.as_py() or "")
                n, node = len(s), own.name(s)[0]
                if not n or node in done:
                    continue
                if len(done) < REMEMBERED:  # spares repeated postings of copies; the rest are merged later
                    done.add(node)
                take = prefix_of(n, percent)
                often = np.zeros(take, bool)
                tokens = s[:take]
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, place[at] + 1, 0)
                    if rank.any():
                        pick = np.argsort(rank, kind="stable")[:take]
                        tokens, often = s[pick], rank[pick] > 0
                parts.append((tokens.view(np.int64).copy(), often))
                sizes.append((node, n, take))
                held += take
                if held >= GIVEN_AT_ONCE:
                    yield given(parts, sizes)
                    parts, sizes, held = [], [], 0
            if parts:
                yield given(parts, sizes)

    return df.select("text").mapInArrow(run, "token long, node long, n int, often boolean")


def shared_lists(rows: DataFrame) -> DataFrame:
    """token, node, n, m: each node of each list of several nodes, once, and the list's length (0: long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the last list so far; of a long one its last row, which has been given
        is_long = False

        def given(token: np.ndarray, node: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(token):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, node, n, m)], ["token", "node", "n", "m"])

        for batch in batches:
            if not batch.num_rows:
                continue
            token, node, n = (np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns[:3], strict=True))
            often = np.concatenate([np.zeros(len(held[0]), bool), batch.column(3).to_numpy(zero_copy_only=False)])
            new = np.ones(len(token), bool)  # copies in other tasks have given the same postings
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, n, often = (x[new] for x in (token, node, n, often))
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.concatenate([first, [len(token)]]))
            m = np.repeat(size, size)
            m[often | (m > LONG * LIST)] = 0
            out = m != 1
            if is_long:
                m[: size[0]] = 0
                out[: size[0]] = True
                out[0] = False
            last = first[-1]
            is_long = bool(m[last] == 0)
            if is_long:
                held = [x[-1:] for x in (token, node, n)]
            else:
                out[last:] = False
                held = [x[last:] for x in (token, node, n)]
            yield from given(*(x[out] for x in (token, node, n, m)))
        if not is_long and len(held[0]) > 1:
            yield from given(*held, np.full(len(held[0]), len(held[0])))

    place = F.when(F.col("often"), F.xxhash64("token", "node")).otherwise(F.col("token"))
    by_token = rows.withColumn("place", place).repartition("place").sortWithinPartitions("often", "token", "node")
    return by_token.select("token", "node", "n", "often").mapInArrow(run, "token long, node long, n long, m long")


def ties(lists: DataFrame, percent: int) -> DataFrame:
    """a, b: edges that join all nodes which may be partners. lists: token, node, n, m of shared lists."""
    least_k = k_column(t_column(F.col("n"), percent), percent)  # of the smallest possible partner
    by_node = W.partitionBy("node")
    order = by_node.orderBy(F.col("m") == 0, "m", "token")
    few = lists.withColumn("place", F.row_number().over(order)).withColumn("c", F.count("*").over(by_node)).filter(F.col("place") <= F.col("c") - least_k + 1)
    parts = F.when(F.col("m") == 0, LONG).otherwise(F.ceil(F.col("m") / LIST))
    few = shared.written(few.select("token", "node", F.pmod(F.xxhash64("node"), parts).alias("part")), "few")
    heads = few.groupBy("token", "part").agg(F.min("node").alias("a"))
    first = heads.groupBy("token").agg(F.min("a").alias("first"))
    edges = few.join(heads, ["token", "part"]).select("a", F.col("node").alias("b"))
    edges = edges.union(heads.join(first, "token").select(F.col("first").alias("a"), F.col("a").alias("b")))
    return edges.filter("a != b").distinct()


class Group:
    """The sets that are compared with each other: inverted lists, and what is linked so far."""

    def __init__(self, nodes: np.ndarray, sets: list[np.ndarray], label: np.ndarray, percent: int = PERCENT) -> None:
        self.percent = percent
        order = np.argsort(nodes)
        self.nodes, sets = nodes[order], [sets[i] for i in order]
        self.size = np.array([len(s) for s in sets])
        m = len(sets)
        owner = np.repeat(np.arange(m), self.size)
        tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
        self.first = np.cumsum(np.concatenate([[0], self.size]))
        self.tokens = place
        self.posting = np.sort(place.astype(np.int64) * m + owner)  # lists one after another, each rising
        self.list_start = np.searchsorted(self.posting, np.arange(len(tokens) + 1, dtype=np.int64) * m)
        self.list_size = np.diff(self.list_start)
        _, self.parent = np.unique(label[order], return_inverse=True)
        self.parent = np.array([np.flatnonzero(self.parent == p)[0] for p in range(self.parent.max() + 1)])[self.parent]
        self.m = m

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def candidates(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """(later sets that reach the required overlap with set x, the overlaps), by DivideSkip."""
        lists = self.tokens[self.first[x] : self.first[x + 1]]
        n, t = len(lists), int(t_of(self.size[x], self.percent))
        lists = lists[np.argsort(self.list_size[lists], kind="stable")]
        # L by the paper's rule, T / (mu log M + 1): fewer lists to probe the longer they are.
        aside = min(t - 1, int(t / (0.05 * np.log2(self.list_size[lists[-1]] + 1) + 1)))
        short, long = lists[: n - aside], lists[n - aside :]
        size = self.list_size[short]
        ends = np.cumsum(size)
        flat = np.repeat(self.list_start[short] - (ends - size), size) + np.arange(ends[-1])
        count = np.bincount(self.posting[flat] % self.m, minlength=self.m)
        found = np.flatnonzero(count >= t - aside)
        found = found[found > x]
        fit = 100 * np.minimum(self.size[found], self.size[x]) >= self.percent * np.maximum(self.size[found], self.size[x])
        found = found[fit]
        if not len(found):
            return found, found
        probe = long.astype(np.int64)[None, :] * self.m + found[:, None]
        at = np.minimum(np.searchsorted(self.posting, probe), len(self.posting) - 1)
        both = count[found] + (self.posting[at] == probe).sum(1)
        good = 100 * both >= self.percent * (self.size[found] + self.size[x] - both)
        return found[good], both[good]

    def links(self) -> list[tuple[int, int]]:
        """Places of sets whose links join what was apart."""
        out = []
        for x in range(self.m):
            if self.size[x]:
                for y in self.candidates(x)[0].tolist():
                    a, b = self.root(x), self.root(y)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
                        out.append((x, y))
        return out


def _group(table: pa.Table, percent: int) -> tuple[Group | None, np.ndarray, np.ndarray]:
    """The sets of a unit (None if all have one label), its nodes, rising, and their labels."""
    nodes, one = np.unique(table["node"].to_numpy(), return_index=True)
    label = table["label"].to_numpy()[one]
    if len(set(label.tolist())) < 2:
        return None, nodes, label
    return Group(nodes, [np.frombuffer(table["shingles"][int(i)].as_py(), np.uint64) for i in one], label, percent), nodes, label


def unit_links(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links between labels within each unit of ``rows`` (unit, node, label, shingles); nodes with one
    label are linked already. Units are bounded, so each fits a task."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group, _, label = _group(table, percent)
        found = np.array(group.links() if group else [], np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(label[found[:, 0]], pa.int64()), "b": pa.array(label[found[:, 1]], pa.int64())})

    return rows.groupBy("unit").applyInArrow(run, "a long, b long")


def unit_roots(rows: DataFrame, percent: int) -> DataFrame:
    """node, root: the least node of its component, where every node is in one unit only (labels: nodes)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group, nodes, _ = _group(table, percent)
        if group:
            group.links()
        root = nodes[[group.root(i) for i in range(len(nodes))]] if group else nodes
        return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(root, pa.int64())})

    return rows.groupBy("unit").applyInArrow(run, "node long, root long")


def shingle_sets(df: DataFrame, seed: int, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(seed, words)
        for batch in batches:
            node, sets, held = [], [], 0
            for k, t in enumerate(batch.column(0), 1):
                s = own.shingles(t.as_py() or "")
                node.append(own.name(s)[0])
                sets.append(s.tobytes())
                held += len(s)
                if held >= GIVEN_AT_ONCE or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])
                    node, sets, held = [], [], 0

    return df.select("text").mapInArrow(run, "node long, shingles binary")


def _large_groups(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, root of groups of more than ``GROUP`` nodes (nodes: node, group)."""
    state = shared.written(nodes.select("node", "group", F.col("node").alias("label")), "large")
    if state.isEmpty():
        return state.select("node", F.col("label").alias("root"))
    for step in range(ROUNDS):
        # One node stands for each component so far; each of these is in one block.
        heads = state.filter("node = label").select("node", "group")
        size = heads.groupBy("group").agg(F.count("*").alias("size"))
        deal = F.pmod(F.xxhash64("node", F.lit(step)), F.ceil(F.col("size") / BLOCK))
        unit = F.xxhash64("group", deal, F.lit(step))
        units = heads.join(size, "group").select("node", F.col("node").alias("label"), unit.alias("unit"))
        roots = unit_roots(units.join(sets, "node"), percent).select(F.col("node").alias("label"), "root")
        state = shared.written(state.join(roots, "label").select("node", "group", F.col("root").alias("label")), "large")
    # Blocks hold nodes of one component where that fills a block, else of several.
    parts = state.groupBy("group", "label").agg(F.count("*").alias("members"))
    parts = parts.withColumn("own", F.col("members") >= BLOCK)
    rest = parts.filter(~F.col("own")).groupBy("group").agg(F.sum("members").alias("loose"))
    parts = parts.join(rest, "group", "left").select(
        "group", "label", F.when(F.col("own"), F.col("label")).alias("only"),
        F.ceil(F.when(F.col("own"), F.col("members")).otherwise(F.col("loose")) / BLOCK).alias("blocks"),
    )
    placed = state.join(parts, ["group", "label"]).withColumn("block", F.xxhash64(F.coalesce("only", F.lit(0)), F.col("only").isNull(), F.pmod(F.xxhash64("node"), "blocks")))
    placed = shared.written(placed.select("node", "group", "label", "only", "block"), "blocks")
    blocks = placed.select("group", "block", "only").distinct()
    other = blocks.select("group", F.col("block").alias("block2"), F.col("only").alias("only2"))
    both = blocks.join(other, "group").filter((F.col("block") <= F.col("block2")) & (F.col("only").isNull() | F.col("only2").isNull() | (F.col("only") != F.col("only2"))))
    unit = F.xxhash64("group", "block", "block2")
    both = shared.written(both.select(unit.alias("unit"), "group", F.explode(F.array_distinct(F.array("block", "block2"))).alias("block")), "units")
    rows = placed.select("node", "label", "group", "block").join(both, ["group", "block"]).join(sets, "node")
    links = unit_links(rows.select("unit", "node", "label", "shingles"), percent)
    roots = connected(links, lambda d: shared.written(d, "round"), shared.discard).select(F.col("node").alias("label"), "root")
    return state.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("root"))


def node_roots(df: DataFrame, docs: DataFrame, seed: int, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """node, root: the components of all nodes that may have partners. df: doc_id, text; docs: doc_id, n, node."""
    lists = shared_lists(postings(df, seed, frequent, words, percent))
    groups = connected(ties(lists, percent), lambda d: shared.written(d, "groups"), shared.discard)
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    nodes = shared.written(groups.join(sizes, "root").select("node", F.col("root").alias("group"), "size"), "nodes")
    one = docs.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes.select("node"), "node", "left_semi").select("doc_id")
    # A node whose rows all lack an id has no least one: all texts without an id are read, and their sets told by node.
    texts = df.join(one, "doc_id", "left_semi").union(df.filter("doc_id is null"))
    sets = shared.written(shingle_sets(texts, seed, words).join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    small = nodes.filter(F.col("size") <= GROUP).select("node", F.col("node").alias("label"), F.col("group").alias("unit"))
    return shared.written(unit_roots(small.join(sets, "node"), percent).union(_large_groups(nodes.filter(F.col("size") > GROUP), sets, percent)), "roots")


def _classes(df: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, n, node of each row; node, root, least of each node with shingles: its component and the
    least doc_id of its rows; the seed). df: doc_id, text."""
    seed = 0
    while True:
        found = shared.written(names(df, seed, words, percent), "names")
        docs = found.filter("kind = 0").select("doc_id", "n", "node", "other")
        nodes = docs.filter("n > 0").groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high"), F.min("n").alias("n1"), F.max("n").alias("n2"))
        if nodes.filter("low != high or n1 != n2").isEmpty():
            break
        seed += 1
    often = found.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).toPandas()
    frequent = np.ascontiguousarray(often["node"].to_numpy(np.int64)[::-1]).view(np.uint64)
    known = docs.filter("n > 0")
    roots = node_roots(df, known, seed, frequent, words, percent)
    least = known.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    return docs.select("doc_id", "n", "node"), named, seed


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, one row for each row of ``df``."""
    docs, named, _ = _classes(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), words, percent)
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(component, "root").select("node", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return docs.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay when one of each component does (the one with the least id), all columns
    as they were; rows without shingles stay. Where ids are missing or repeat, rows are told apart by the
    names of their sets, worked out once more, so that of equal rows one stays."""
    columns = df.columns
    docs, named, seed = _classes(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), words, percent)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("first")).select("first.least", "first.node")
    empty = docs.filter("n = 0")
    repeats = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 or doc_id is null")
    if repeats.isEmpty():
        stay = first.select(F.col("least").alias("stay_id")).union(empty.select("doc_id"))
        return df.join(stay, df[doc_id].cast("long") == stay["stay_id"], "left_semi")

    @F.pandas_udf("long")
    def node_of(texts: pd.Series) -> pd.Series:
        own = Shingler(seed, words)
        found = [own.shingles(t or "") for t in texts]
        return pd.Series([own.name(s)[0] if len(s) else None for s in found], dtype="Int64")

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), node_of(F.col(text)).alias("stay_node"), F.col(doc_id).cast("long").alias("stay_id"))
    rows = shared.written(rows, "named")
    stay = first.select(F.col("node").alias("n2"), F.col("least").alias("id2"))
    one = rows.join(stay, (rows["stay_node"] == stay["n2"]) & rows["stay_id"].eqNullSafe(stay["id2"])).dropDuplicates(["stay_node"])
    out = one.select("row").union(rows.filter("stay_node is null").select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns])
