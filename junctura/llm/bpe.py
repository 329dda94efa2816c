"""Byte-level BPE by backtracking, and decoding by an offset table.

Encoding a piece: an Aho-Corasick automaton gives the longest token at each place; a token is taken
if it can stand beside the one before, which a walk over the two tokens' merges tells (no merge that
would come earlier joins what stands on either side of the border; the answers are kept in a table).
Else the next shorter prefix token is tried, and where none fits the last token is taken back and the
place is marked, so no place is tried twice: exact merges in linear time, for pieces of any length.

Texts are cut into units (white space and what follows it) that no token spans; the units of a batch
that aren't remembered are encoded together, one step of each at a time, in numpy. What is remembered
is bounded, the oldest going first, which changes no result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Remembered in each of two generations; the older one goes when the newer is full.
UNITS_KEPT = 250_000
PAIR_SLOTS = 1 << 20
#: Bits of a token in the table of pairs.
PAIR_BITS = 17
LONG_PIECE = 64
BATCH_CHARS = 1 << 20
#: The white space of Unicode, and the pattern that splits text before merges.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^WHITE\p{L}\p{N}]+|[WHITE]+(?![^WHITE])|[WHITE]+".replace("WHITE", WHITE)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the others
    from code point 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class ByteBpe:
    """The vocabulary of a tokenizer file; tokens are numbered by merge rank inside (bytes first)."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        names = [*letters, *(a + b for a, b in merges)]
        if len(names) > 1 << PAIR_BITS:
            raise ValueError(f"the table of pairs tells {1 << PAIR_BITS} tokens apart; the file has {len(names)}")
        self.rank = {}
        for k, name in enumerate(names):
            self.rank.setdefault(name, k)
        vocab = spec["model"]["vocab"]
        self.halves = [(k, k) for k in range(256)] + [(self.rank[a], self.rank[b]) for a, b in merges]
        self.joined = {}
        for k, pair in enumerate(self.halves[256:], 256):
            self.joined.setdefault(pair, k)
        self.id_of = np.array([vocab.get(name, -1) for name in names], "<u4")
        self.length = np.array([len(name) for name in names])
        self.shorter = np.array([next((self.rank[n[:i]] for i in range(len(n) - 1, 0, -1) if n[:i] in self.rank), -1) for n in names])
        self.lists = self.length.tolist(), self.shorter.tolist()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for name, k in self.rank.items():
            if len(name) > 1:
                self.automaton.add_word(name, k)
        self.letter_rank = np.zeros(512, np.int64)
        self.letter_rank[list(map(ord, letters))] = np.arange(256)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.rare_white = re.compile(f"[{WHITE.replace(' ', '').replace(WHITE[:5], '')}]")
        self.pieces = regex.compile(PIECES)
        self.letter_table = dict(enumerate(letters))
        self.pair_key = np.full(PAIR_SLOTS, -1)
        self.pair_ok = np.zeros(PAIR_SLOTS, bool)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        back = {ch: b for b, ch in enumerate(letters)}
        words = {i: bytes(back[ch] for ch in name) if all(ch in back for ch in name) else name.encode() for name, i in vocab.items()}
        words |= {i: name.encode() for name, i in self.special.items()}
        ordered = [words.get(i, b"") for i in range(max(words, default=-1) + 1)]
        self.blob = np.frombuffer(b"".join(ordered), np.uint8)
        self.offset = np.cumsum([0, *map(len, ordered)])
        self.decimal = [b"%d," % i for i in range(len(ordered))]

    def may_stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging both tokens' bytes leaves the border between them.
        The table holds the pairs met so far; a pair may push out another, which is then worked out anew."""
        key = left << PAIR_BITS | right
        slot = (key * 0x9E3779B1 >> 12) & (PAIR_SLOTS - 1)
        ok = self.pair_ok[slot]
        for k in np.flatnonzero(self.pair_key[slot] != key):
            at = slot[k]
            if self.pair_key[at] != key[k]:
                self.pair_key[at], self.pair_ok[at] = key[k], self._may_stand(int(left[k]), int(right[k]))
            ok[k] = self.pair_ok[at]
        return ok

    def _may_stand(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens again and again; at each step the two tokens at the border
        # were there together until `until`, so a merge of them before that would have joined them.
        until = len(self.halves)
        while True:
            if self.joined.get((left, right), until) < until:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                until, left = left, self.halves[left][1]
            else:
                # merges of one rank go from left to right, so one at the border comes before the right token's own
                until, right = right + 1, self.halves[right][0]

    def merge(self, pieces: list[str]) -> list[bytes]:
        """Ids (packed, 4 bytes each) of each piece; pieces are not empty."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw])
        first = np.cumsum(size + 1) - size - 1
        letters = "\n".join([r.decode("latin-1").translate(self.letter_table) for r in raw])  # no letter is a line feed
        n = len(letters)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(letters)), np.int64).reshape(-1, 2)
        longest = np.zeros(n + 1, np.int64)
        longest[:n] = self.letter_rank[np.frombuffer(letters.encode("utf-16-le"), "<u2")]
        longest[found[:, 0] - self.length[found[:, 1]] + 1] = found[:, 1]  # ends rise, so the longest comes last
        is_open, taken = np.ones(n + 1, bool), np.zeros(n + 1, bool)
        token_at, came_from = np.zeros(n + 1, np.int64), np.full(n + 1, -1)
        at, stop = first.copy(), first + size
        token = longest[at]
        while len(at):
            end = at + self.length[token]
            start = came_from[at]
            last = token_at[start]
            good = is_open[end]
            check = np.flatnonzero(good & (start >= 0))
            good[check] = self.may_stand(last[check], token[check])
            took = at[good]
            token_at[took], taken[took], came_from[end[good]] = token[good], True, took
            less = self.shorter[token]
            # Where nothing shorter is left, the last token is taken back; as its end is marked, a shorter one follows.
            undo = ~good & (less < 0)
            is_open[at[undo]] = False
            taken[start[undo]] = False
            token = np.where(good, longest[np.minimum(end, n)], np.where(undo, last, less))
            at = np.where(good, end, np.where(undo, start, at))
            going = at < stop
            if not going.all():
                at, token, stop = at[going], token[going], stop[going]
        ids = self.id_of[token_at[:-1][taken[:-1]]].tobytes()
        until = np.cumsum(taken)[first + size - 1] * 4
        return [ids[a:b] for a, b in zip([0, *until[:-1].tolist()], until.tolist())]

    def merge_long(self, piece: str) -> bytes:
        """The same for one long piece, token by token."""
        letters = piece.encode().decode("latin-1").translate(self.letter_table)
        n = len(letters)
        longest = [self.rank[x] for x in letters]
        for end, token in self.automaton.iter(letters):
            longest[end - int(self.length[token]) + 1] = token
        length, shorter = self.lists
        beside: dict[tuple[int, int], bool] = {}
        is_open, out, at, token = bytearray(b"\1" * (n + 1)), [], 0, longest[0]
        while at < n:
            end = at + length[token]
            good = bool(is_open[end])
            if good and out:
                pair = (out[-1], token)
                if (good := beside.get(pair)) is None:
                    good = beside[pair] = self._may_stand(*pair)
            if good:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                is_open[at] = 0
                token = out.pop()
                at -= length[token]
        return self.id_of[out].tobytes()

    def units_of(self, text: str) -> list[str]:
        """Units that no token spans. Where single spaces and line feeds stand between words, they are cut
        before each; else at white space in general."""
        odd = any(x in text for x in ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\0"))
        if odd or not text.isascii() and self.rare_white.search(text):
            return self.units.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def learn(self, units: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of units that aren't remembered; remembers them."""
        cut, new, made = {}, set(), {}
        for u in units:
            if (known := self.older.get(u)) is not None:
                made[u] = known
            elif not (u[1:] if u[:1] == " " else u).isalpha():
                cut[u] = self.pieces.findall(u)
                new.update(cut[u])
            else:
                new.add(u)
        for p in new:
            if (known := self.kept.get(p) or self.older.get(p)) is not None:
                made[p] = known
        rest = [p for p in new if p not in made]
        short = [p for p in rest if len(p) <= LONG_PIECE]
        made.update(zip(short, self.merge(short) if short else [], strict=True))
        made.update((p, self.merge_long(p)) for p in rest if len(p) > LONG_PIECE)
        made.update((u, b"".join([made[p] for p in ps])) for u, ps in cut.items())
        if len(self.kept) + len(made) > UNITS_KEPT:
            self.kept, self.older = {}, self.kept
        self.kept.update((k, v) for k, v in made.items() if len(k) <= LONG_PIECE)
        return made

    def cut(self, text: str) -> list[str]:
        if self.splitter is None or not any(x in text for x in self.special):
            return self.units_of(text)
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += [*self.units_of(text[at : m.start()]), m]
            at = m.end()
        return out + self.units_of(text[at:])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        cuts = [self.cut(t) for t in texts]
        new = {u for units in cuts for u in units if u not in self.kept and isinstance(u, str)}
        more = self.learn(new) if new else {}
        known = self.kept
        try:
            return [b"".join([known[u] for u in units]) for units in cuts]
        except KeyError:  # special tokens, units too long to keep, or what is remembered has just been renewed
            return [b"".join([self._one(u, more) for u in units]) for units in cuts]

    def _one(self, unit: str | regex.Match, more: dict[str, bytes]) -> bytes:
        if not isinstance(unit, str):
            return np.array([self.special[unit[0]]], "<u4").tobytes()
        if (found := more.get(unit)) is None and (found := self.kept.get(unit)) is None:
            found = self.older.get(unit) or self.learn([unit])[unit]
        return found

    def batches(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Packed ids of each text, some texts at a time."""
        some, chars = [], 0
        for t in texts:
            some.append(t or "")
            chars += len(some[-1])
            if chars >= BATCH_CHARS:
                yield from self.encode_all(some)
                some, chars = [], 0
        yield from self.encode_all(some)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], "<u4")

    def as_decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return b"".join(map(self.decimal.__getitem__, ids.tolist()))[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: places in the table's blob, gathered at once."""
        start = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return b""
        return self.blob[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(path)


def round_trip(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text. A null text is an empty one; rows are
    independent of each other, so repeated rows, ties and empty tables need no care."""
    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for packed in bpe.batches(value.as_py() for value in batch.column(1)):
                ids = np.frombuffer(packed, "<u4")
                count.append(len(ids))
                ids_sha.append(sha256(bpe.as_decimal(ids)).hexdigest())
                text_sha.append(sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def tokenized(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``df`` with token_ids of each text, n_tokens, and decoded (what the ids decode to); columns of these
    names are replaced (names are told apart as Spark does, without case). A null text has no ids. Rows
    leave Python a few megabytes at a time, so memory doesn't grow with the length of texts but for one."""

    @F.arrow_udf("token_ids array<int>, n_tokens long, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(tokenizer)

        def packed_rows(ids: list[bytes]) -> pa.Array:
            size = np.array([len(i) // 4 for i in ids], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            decoded = pa.array([bpe.decode(np.frombuffer(i, "<u4")) for i in ids], pa.binary()).cast(pa.string())
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, values), pa.array(size), decoded], ["token_ids", "n_tokens", "decoded"])

        for texts in batches:
            some, held = [], 0
            for ids in bpe.batches(t.as_py() for t in texts):
                some.append(ids)
                held += len(ids)
                if held >= BATCH_CHARS:
                    yield packed_rows(some)
                    some, held = [], 0
            yield packed_rows(some)

    made = ("token_ids", "n_tokens", "decoded")
    names = [c for c in df.columns if c.lower() not in made]
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), run(F.col(text)).alias("made"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], *[F.col("made").getField(c).alias(c) for c in made])
