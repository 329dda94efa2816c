"""Language identification with string kernels.

Texts are lower-cased. The blended-spectrum presence kernel of two texts is the number of n-grams of one to
``ORDER`` code points that both contain, divided by the root of the product of the numbers that each
contains; n-grams are told apart by hashes of 64 bits, so no alphabet is preferred, texts of any length are told
apart and memory grows with a text's different n-grams only. Landmarks (training texts) give the Nyström features
k(x, landmarks) K^(-1/2); on those, one ridge regression for each language against the rest is solved in
closed form: its normal equations are added up where the training texts lie. Scoring is two matrix products
for a batch of texts. The whole of every text counts.

The classifier is fitted on a bounded sample: for each language the ``PER_LANGUAGE`` documents of at most
``TRAINING_CHARS`` characters with the least hash of their id; ``LANDMARKS`` of these, the languages by
turns, are landmarks. Only ids, the landmarks' texts and sums reach the driver.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal scores give the first
language by name; without training rows every text is ``und``; repeated rows are judged alike; an empty
table gives an empty one; of further columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = 3
PER_LANGUAGE = 200
TRAINING_CHARS = 20_000
LANDMARKS = 256
RIDGE = 1e-3
BATCH = 128
#: Code points of a long text that are hashed at once.
BLOCK = 1 << 20
#: Training rows of a task that adds up normal equations.
ROWS_A_TASK = 500
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Kernel:
    """Presence of n-grams; ``at`` are those that ``texts`` contain, in order."""

    def __init__(self, texts: list[str]) -> None:
        self.at = np.unique(np.concatenate([np.zeros(0, np.uint64), *[self.grams(t) for t in texts]]))

    @staticmethod
    def grams(text: str) -> np.ndarray:
        """The hash of every different n-gram of the text, in order. A long text is taken in blocks, so memory grows with
        what is different in it."""
        s = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        found = np.zeros(0, np.uint64)
        for start in range(0, len(s), BLOCK):
            code = part = s[start : start + BLOCK + ORDER - 1].astype(np.uint64) + np.uint64(1)
            out = [found]
            for n in range(min(ORDER, len(part))):
                if n:
                    code = code[:-1] * _ODD[0] + part[n:]
                mixed = (code ^ (code >> np.uint64(29))) * _ODD[1] + _ODD[n % 2]
                out.append(mixed ^ (mixed >> np.uint64(32)))
            found = np.unique(np.concatenate(out))
        return found

    def presence(self, text: str, at: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """(presence of the n-grams ``at``, or the hashes of all that are present; how many are present)."""
        found = self.grams(text)
        if at is None:
            return found, len(found)
        row = np.zeros(len(at), np.float32)
        place = np.searchsorted(at, found)
        inside = place < len(at)
        place, held = place[inside], found[inside]
        row[place[at[place] == held]] = 1
        return row, len(found)


class Landmarks:
    """Nyström features of texts, from the texts that are landmarks."""

    def __init__(self, texts: list[str]) -> None:
        self.kernel = Kernel(texts)
        self.marks, self.mark_norm = self.rows(texts)
        among = self.marks @ self.marks.T / self.mark_norm[:, None] / self.mark_norm[None, :]
        value, vector = np.linalg.eigh(among.astype(float))
        kept = value > 1e-6 * value.max()
        self.root = vector[:, kept] / np.sqrt(value[kept])

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.zeros((len(texts), len(self.kernel.at)), np.float32)
        norm = np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            rows[i], n = self.kernel.presence(t, self.kernel.at)
            norm[i] = np.sqrt(max(n, 1))
        return rows, norm

    def similar(self, texts: list[str]) -> np.ndarray:
        rows, norm = self.rows(texts)
        return rows @ self.marks.T / self.mark_norm[None, :] / norm[:, None]

    def sums(self, texts: list[str], langs: list[str], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The normal equations of these texts: features' products with each other and with +1 or -1 for each language."""
        size = self.root.shape[1] + 1
        left, right = np.zeros((size, size)), np.zeros((size, len(languages)))
        for at in range(0, len(texts), BATCH):
            some = texts[at : at + BATCH]
            features = np.hstack([self.similar(some) @ self.root, np.ones((len(some), 1))])
            wanted = np.array([[1.0 if y == x else -1.0 for x in languages] for y in langs[at : at + BATCH]])
            left += features.T @ features
            right += features.T @ wanted
        return left, right


class Model:
    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS) -> None:
        """Fitted on texts at hand, of which the first ones are landmarks."""
        marks = Landmarks(texts[:landmarks])
        languages = sorted(set(langs))
        self._solve(marks, languages, len(texts), *marks.sums(texts, langs, languages))

    @classmethod
    def of(cls, marks: Landmarks, languages: list[str], n: int, left: np.ndarray, right: np.ndarray) -> Model:
        """Fitted on the normal equations of n texts."""
        out = cls.__new__(cls)
        out._solve(marks, languages, n, left, right)
        return out

    def _solve(self, marks: Landmarks, languages: list[str], n: int, left: np.ndarray, right: np.ndarray) -> None:
        weights = np.linalg.solve(left + RIDGE * n * np.eye(len(left)), right)
        self.marks, self.languages = marks, languages
        self.weights, self.bias = (marks.root @ weights[:-1]).astype(np.float32), weights[-1].astype(np.float32)

    def _kernel(self, texts: list[str]) -> np.ndarray:
        return self.marks.similar(texts)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        value = self._kernel(texts) @ self.weights + self.bias
        best = value.argmax(1)
        share = np.exp(2 * value - 2 * value.max(1, keepdims=True))
        share = share.max(1) / share.sum(1)
        return [self.languages[i] for i in best], share.astype(float).tolist()


def fit(df: DataFrame, may_learn, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """The model of the sample, None without any: ids first, without texts, then the landmarks' texts, then the
    sums over the sample's texts."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= TRAINING_CHARS) & may_learn(F.col("doc_id")))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = rows.select("doc_id", "lang").distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PER_LANGUAGE).collect()
    if not few:
        return None
    few.sort(key=lambda r: (r["k"], r["lang"]))
    languages = sorted({r["lang"] for r in few})
    spark, kind = df.sparkSession, df.schema[doc_id].dataType.simpleString()

    def texts_of(ids: list) -> DataFrame:
        wanted = spark.createDataFrame([(r["doc_id"], r["lang"]) for r in ids], f"doc_id {kind}, lang string")
        return rows.join(F.broadcast(wanted), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # PER_LANGUAGE ids a language

    found = {(r["doc_id"], r["lang"]): r["text"] for r in texts_of(few[:LANDMARKS]).collect()}
    marks = Landmarks([found[r["doc_id"], r["lang"]] for r in few[:LANDMARKS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = marks.root.shape[1] + 1
        n, left, right = 0, np.zeros((size, size)), np.zeros((size, len(languages)))
        for batch in batches:
            more = marks.sums(batch.column(1).to_pylist(), batch.column(0).to_pylist(), languages)
            n, left, right = n + batch.num_rows, left + more[0], right + more[1]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (left, right)]], ["n", "left", "right"])

    sums = texts_of(few).select("lang", "text").coalesce(-(-len(few) // ROWS_A_TASK)).mapInArrow(run, "n long, left binary, right binary").collect()
    total = [sum(np.frombuffer(r[c]) for r in sums) for c in ("left", "right")]
    return Model.of(marks, languages, sum(r["n"] for r in sums), total[0].reshape(len(total[0]) // (marks.root.shape[1] + 1), -1), total[1].reshape(marks.root.shape[1] + 1, -1))


def identify(df: DataFrame, may_learn, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score; ``may_learn`` says of a doc_id whether its row may be learned from."""
    model = fit(df, may_learn, doc_id, text, lang)
    letter = regex.compile(r"\p{L}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for at in range(0, batch.num_rows, BATCH):
                texts = [t or "" for t in batch.column(1).slice(at, BATCH).to_pylist()]
                known = [i for i, t in enumerate(texts) if model and letter.search(t)]
                name, score = ["und"] * len(texts), [0.0] * len(texts)
                if known:
                    for i, x, y in zip(known, *model.predict([texts[i] for i in known]), strict=True):
                        name[i], score[i] = x, y
                names += name
                scores += score
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
