"""Token ids in files: frequency-ranked, in byte-aligned codes of variable length.

Format. ``ranks.bin`` holds the ids by falling frequency in the whole corpus (4 bytes each). Each
``ids-NNNNNN.svb`` holds documents in ascending doc_id: eight 8-byte numbers (magic, version, documents,
ids, ids in all files before, bytes of the control part, bytes of the data part, 0); then doc_ids (8
bytes each), flags of null doc_ids (1), ids a document (8); then the control part, two bits an id, four
ids a byte, lowest first, each the number of data bytes less one; then the data bytes of the ranks,
lowest byte first. Control bytes lie apart, so that a table of 256 rows tells the four lengths at once.

Writing. Documents are placed by doc_id (the ids alone give the bounds; whole texts move once), encoded
in order, and left as draft files with their counts; the counts of all drafts give the ranks; each draft
is then written anew in its final form and removed. Files are written under another name and renamed, so
tasks may be lost or run twice. What reaches the driver is bounded by the vocabulary and the number of
files. Reading back goes through Spark's binaryFile reader.

Defined cases: a null text is an empty one (the end id alone); rows with one id are ordered by text; a
null doc_id comes first and is read back as null; an empty table gives no documents; further columns are
not read.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .bpe import byte_letters

MAGIC = 0x31_42_56_53_44_49_4B_54
CHUNKS_KEPT = 250_000
BATCH_CHARS = 1 << 17
#: Separators that Python's split() takes for white space and Unicode doesn't.
NOT_WHITE = "\x1c\x1d\x1e\x1f"
#: Fixed value: words of letters that normalisation leaves single letters, but lower-cases; each is one pre-token.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A mark after such a letter and before white space: it is a pre-token of its own.
LONE_MARK = re.compile("[.,!?;](?<=[A-Za-zÀ-ÖØ-öø-ÿ].)(?=[\t-\r \x85\xa0]|\\Z)")
#: Fixed value: a byte that UTF-8 never has.
END_BYTE = b"\xff"
#: Longer chunks aren't remembered.
LONGEST_KEPT = 64
CHUNKS = re.compile(r"[^\t-\r \x85\xa0  -     　]+")


class ChunkEncoder:
    """The tokenizers library over the chunks between white space, which its pre-tokenizer never spans, and for plain
    words tiktoken with the same merges, which is several times faster; chunks are remembered in two bounded
    generations, which changes no result."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.kind = "<u2" if self.size <= 65536 else "<u4"  # of an id in what is remembered and given out
        self._ranked(path)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that aren't in ``kept``; remembers those that aren't long."""
        older = self.older
        made = {c: older[c] for c in chunks if c in older}
        rest = chunks.difference(made)
        plain = [c for c in rest if PLAIN.fullmatch(c)]
        made.update(self._plain(plain))
        rest = list(rest.difference(made))
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            made[c] = np.array(e.ids, self.kind).tobytes()
        self.kept.update(made if max(map(len, made), default=0) <= LONGEST_KEPT else {k: v for k, v in made.items() if len(k) <= LONGEST_KEPT})
        return made

    def _plain(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters, by tiktoken; none if it can't stand for this file."""
        if self.fast is None:
            return {}
        encode, id_of, kind = self.fast.encode_single_piece, self.id_of, self.kind
        return {w: id_of[encode(w.lower().encode() + END_BYTE)].astype(kind).tobytes() for w in words}

    def _ranked(self, path: str) -> None:
        """tiktoken with the file's merges. A word ends in a byte that no text holds; joining it to the byte before
        comes before all merges, so the last letter is the one that ends a word, as in the file. Ranks are told by
        the order of the merges, ids by a table."""
        import tiktoken

        self.fast = None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, vocab, letters = model.get("end_of_word_suffix"), model["vocab"], byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if end != "</w>" or model.get("continuing_subword_prefix") or not {*letters, *(x + end for x in letters)} <= set(vocab):
            return
        back = {letter: byte for byte, letter in enumerate(letters)}

        def raw(token: str) -> bytes:
            bare = token.removesuffix(end)
            return bytes(back[x] for x in bare) + END_BYTE * (bare != token)

        names = [*letters, *(x + end for x in letters), *("".join(m) for m in merges)]
        ranks = {raw(n): k for k, n in enumerate(names)}
        if len(ranks) == len(names) and all(n in vocab for n in names):
            self.id_of = np.array([vocab[n] for n in names])
            self.fast = tiktoken.Encoding("file", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _chunks(self, text: str) -> list[str]:
        text = LONE_MARK.sub(" \\g<0>", text)
        if any(x in text for x in NOT_WHITE):
            return CHUNKS.findall(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return text.lower().split()  # here as the tokenizer lower-cases: letter by letter

    def _all(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > CHUNKS_KEPT:
            self.kept, self.older = {}, self.kept
        known, found, new = self.kept.get, [], set()
        for t in texts:
            chunks = self._chunks(t)
            ids = list(map(known, chunks))
            missing, at = [], -1
            with contextlib.suppress(ValueError):  # no more of them
                while True:
                    at = ids.index(None, at + 1)
                    missing.append((at, chunks[at]))
            new.update(c for _, c in missing)
            found.append((ids, missing))
        made = self._learn(new) if new else {}
        for ids, missing in found:
            for at, c in missing:
                ids[at] = made[c]
        return [b"".join(ids) for ids, _ in found]

    def batches(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        some, chars = [], 0
        for t in texts:
            some.append(t or "")
            chars += len(some[-1])
            if chars >= BATCH_CHARS:
                yield from self._all(some)
                some, chars = [], 0
        yield from self._all(some)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of whole numbers below 2**32."""
    values = np.ascontiguousarray(values, "<u4")
    size = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    four = np.zeros(-(-len(size) // 4) * 4, np.uint8)
    four[: len(size)] = size
    control = four[0::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6
    return control.tobytes(), data.tobytes()


#: The four lengths that each control byte tells.
LENGTHS = np.stack([(np.arange(256) >> shift & 3) + 1 for shift in (0, 2, 4, 6)], 1).astype(np.uint8)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    data = np.frombuffer(data + b"\0\0\0", np.uint8)
    start = np.cumsum(size, dtype=np.int64) - size
    out = data[start].astype("<u4")
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= data[start[longer] + k].astype("<u4") << np.uint32(8 * k)
    return out


def file_bytes(doc_ids: list[int | None], sizes: np.ndarray, start: int, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = np.array([MAGIC, 1, len(sizes), len(ranks), start, len(control), len(data), 0], "<i8").tobytes()
    ids = np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    null = np.array([i is None for i in doc_ids], np.uint8).tobytes()
    return head + ids + null + np.asarray(sizes, "<i8").tobytes() + control + data


def parse(data: bytes, by_rank: np.ndarray) -> tuple[list[int | None], np.ndarray, int, np.ndarray]:
    """doc_ids, ids a document, ids before, ids."""
    magic, _, docs, n, start, n_control, n_data, _ = np.frombuffer(data, "<i8", 8).tolist()
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    at = 64
    ids = np.frombuffer(data, "<i8", docs, at).tolist()
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    ranks = unpack(data[at : at + n_control], data[at + n_control : at + n_control + n_data], n)
    return [None if x else i for i, x in zip(ids, null, strict=True)], sizes, start, by_rank[ranks]


def write(df: DataFrame, tokenizer: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text, each followed by ``end_id``, to ``folder``."""
    df = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bounds = np.array(shared.range_bounds(df, "doc_id", shared.ordered_parts(df)), np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right"))

    placed = df.withColumn("part", part(F.coalesce("doc_id", F.lit(-(1 << 63))))).repartitionById(len(bounds) + 1, F.col("part"))
    placed = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select("part", "doc_id", "text")

    def drafts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        ids, sizes, packed, number = [], [], [], None
        end = np.array([end_id], own.kind).tobytes()
        width = len(end)
        for batch in batches:
            if batch.num_rows:
                number = batch.column(0)[0].as_py()
                ids += batch.column(1).to_pylist()
                for p in own.batches(t.as_py() for t in batch.column(2)):
                    sizes.append(len(p) // width + 1)
                    packed += [p, end]
        if number is None:
            return
        joined = b"".join(packed)
        del packed
        count = np.bincount(np.frombuffer(joined, f"<u{width}"), minlength=1)
        body = pa.compress(joined, codec="zstd", asbytes=True)
        head = np.array([width, len(ids), len(joined)], "<i8").tobytes()
        keep = head + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes()
        system, root = shared.filesystem(folder)
        shared.put(system, f"{root}/drafts/{number}.bin", keep + np.array(sizes, "<i8").tobytes() + body)
        used = np.flatnonzero(count)
        rows = [[number], [-1], [len(joined) // width]]
        rows = [np.concatenate([a, b]) for a, b in zip(rows, (np.full(len(used), number), used, count[used]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["part", "id", "n"])

    counts = shared.written(placed.mapInArrow(drafts, "part long, id long, n long"), "id-counts")
    parts = sorted(counts.filter("id < 0").select("part", "n").toPandas().itertuples(index=False, name=None))
    by_id = counts.filter("id >= 0").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    by_rank = by_id.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy("<u4")
    system, root = shared.filesystem(folder)
    shared.put(system, f"{root}/ranks.bin", by_rank.tobytes())
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
    rank_of[by_rank] = np.arange(len(by_rank))
    starts, total = [], 0
    for number, n in parts:
        starts.append((int(number), int(total)))
        total += n
    if not starts:
        return
    spark = df.sparkSession
    todo = spark.createDataFrame([(k, *s) for k, s in enumerate(starts)], "task int, part long, start long")
    todo = todo.repartitionById(len(starts), F.col("task")).select("part", "start")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = shared.filesystem(folder)
        from pyarrow import fs

        for batch in batches:
            for number, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                draft, to = f"{root}/drafts/{number}.bin", f"{root}/ids-{number:06d}.svb"
                if system.get_file_info(to).type == fs.FileType.NotFound:
                    with system.open_input_stream(draft) as f:
                        data = f.read()
                    width, docs, size = np.frombuffer(data, "<i8", 3).tolist()
                    ids = np.frombuffer(data, "<i8", docs, 24).tolist()
                    null = np.frombuffer(data, np.uint8, docs, 24 + 8 * docs)
                    sizes = np.frombuffer(data, "<i8", docs, 24 + 9 * docs)
                    body = pa.decompress(data[24 + 17 * docs :], decompressed_size=size, codec="zstd", asbytes=True)
                    ranks = rank_of[np.frombuffer(body, f"<u{width}")]
                    shared.put(system, to, file_bytes([None if x else i for i, x in zip(ids, null, strict=True)], sizes, start, ranks))
                if system.get_file_info(draft).type != fs.FileType.NotFound:
                    system.delete_file(draft)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["part"])

    todo.mapInArrow(final, "part long").agg(F.count("*")).collect()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in ``folder``'s files."""
    system, root = shared.filesystem(folder)
    with system.open_input_stream(f"{root}/ranks.bin") as f:
        by_rank = np.frombuffer(f.read(), "<u4")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                ids, sizes, start, values = parse(content.as_py(), by_rank)
                ends = np.cumsum(sizes)
                raw = memoryview(np.ascontiguousarray(values, "<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(ids, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    if not len(by_rank):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.svb").load(folder).select("content")
    return files.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    folder = shared.fresh_path(df.sparkSession, "id-files")
    write(df, tokenizer, folder, end_id, doc_id, text)
    return read(df.sparkSession, folder)
