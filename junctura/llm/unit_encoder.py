"""Ids as the tokenizers library gives them, for byte-level BPE: each different unit of the texts is encoded once.

Units are white space and what follows it (``bpe`` cuts them); no token spans two. Units that begin with one space
are encoded many at once, as one text, and parted again at the tokens that begin with a space. That is done by
tiktoken, which is several times faster, with the file's own tokens, if ids rise with the file's merges (checked on
loading), for units of code points below ``PLAIN_BELOW``, whose classes all libraries share; the tokenizers library
encodes the rest. What is remembered is bounded, in two generations, which changes no result. Texts that hold a
special token's string are encoded whole.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from . import bpe

UNITS_KEPT = 400_000
LONGEST_KEPT = 64
UNITS_AT_ONCE = 2000
BATCH_CHARS = 1 << 19
PLAIN_BELOW = 0x250
SPACE = "Ġ"  # fixed value: the letter that stands for a space in the vocabulary


class UnitEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.kind = "<u2" if size <= 65536 else "<u4"  # of an id in what is remembered and given out
        self.begins = np.zeros(size, bool)
        self.begins[[i for token, i in vocab.items() if token.startswith(SPACE)]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units = re.compile(f"[{bpe.WHITE}]*[^{bpe.WHITE}]+|[{bpe.WHITE}]+")
        self.rare_white = re.compile(f"[{bpe.WHITE.replace(' ', '').replace(bpe.WHITE[:5], '')}]")
        self.odd = re.compile(f"[^\\0-{chr(PLAIN_BELOW - 1)}]")
        self.fast = self._ranked(path)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    units_of = bpe.ByteBpe.units_of

    @staticmethod
    def _ranked(path: str):
        """tiktoken with the file's tokens; none if their ids don't rise with the merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {letter: byte for byte, letter in enumerate(bpe.byte_letters())}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:])) or model.get("ignore_merges") or not set(back) <= set(model["vocab"]):
            return None
        used = {*back, *("".join(m) for m in merges)}
        ranks = {bytes(back[x] for x in token): model["vocab"][token] for token in used}
        return tiktoken.Encoding("file", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={}) if max(ranks[bytes([b])] for b in range(256)) < made[0] else None

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, units: list[str]) -> list[bytes]:
        ids = self.fast.encode_to_numpy("".join(units)).astype(self.kind)
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(units):
            return self._encoded(units)
        packed, at = ids.tobytes(), (at * ids.itemsize).tolist()
        return [packed[a:b] for a, b in zip(at, [*at[1:], len(packed)], strict=True)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        older = self.older
        made = {u: older[u] for u in new if u in older}
        rest = new.difference(made)
        odd = self.odd.search
        spaced = [u for u in rest if u[0] == " " and 1 < len(u) <= LONGEST_KEPT and not u[1].isspace() and not odd(u)] if self.fast else []
        for at in range(0, len(spaced), UNITS_AT_ONCE):
            some = spaced[at : at + UNITS_AT_ONCE]
            made.update(zip(some, self._joined(some), strict=True))
        alone = [u for u in rest if u not in made]
        made.update(zip(alone, self._encoded(alone), strict=True))
        self.kept.update((u, ids) for u, ids in made.items() if len(u) <= LONGEST_KEPT)
        return made

    def _all(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > UNITS_KEPT:
            self.kept, self.older = {}, self.kept
        known, found, new = self.kept.get, [], set()
        for text in texts:
            if any(s in text for s in self.special):
                found.append((self._encoded([text]), []))
                continue
            units = self.units_of(text) if text else []
            ids = list(map(known, units))
            missing, at = [], -1
            with contextlib.suppress(ValueError):  # no more of them
                while True:
                    at = ids.index(None, at + 1)
                    missing.append((at, units[at]))
            new.update(u for _, u in missing if u)
            found.append((ids, missing))
        made = self._learn(new) if new else {}
        made[""] = b""
        for ids, missing in found:
            for at, u in missing:
                ids[at] = made[u]
        return [b"".join(ids) for ids, _ in found]

    def batches(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, some texts at a time."""
        some, chars = [], 0
        for t in texts:
            some.append(t or "")
            chars += len(some[-1])
            if chars >= BATCH_CHARS:
                yield from (np.frombuffer(p, self.kind) for p in self._all(some))
                some, chars = [], 0
        yield from (np.frombuffer(p, self.kind) for p in self._all(some))


@lru_cache(maxsize=2)
def load(path: str) -> UnitEncoder:
    """One for each worker process."""
    return UnitEncoder(path)
