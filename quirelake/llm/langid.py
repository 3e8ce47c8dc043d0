"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of the lower-cased whole text (anything but
letters counts as a blank), weighted by 1 + ln(tf) times idf and scaled to length one.
Document frequencies cover every training row. The weights are fitted by
follow-the-regularised-leader with elastic-net penalties on about ``bound`` labelled rows
(never over twice that), taken evenly over the languages by a hash of the id; a fifth of these is left out of
the fit and sets the temperature that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import python_batches, valid_utf8, values, working

DIM_BITS = 15
DIM = 1 << DIM_BITS
UND = "und"
#: Labelled rows fitted on, about; never over twice as many.
BOUND = 2000
#: Languages learned, at most: the most frequent labels.
LANGUAGES = 256


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and their counts; none for a text without a letter."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (c != 32).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
    letter = c != 32
    shift, prime = np.uint32(32 - DIM_BITS), np.uint32(2654435761)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA77) + c[2:]
    counts = np.bincount((c[letter] * prime) >> shift, minlength=DIM)
    counts += np.bincount((two[letter[:-1] | letter[1:]] * prime) >> shift, minlength=DIM)
    counts += np.bincount((three[letter[1:-1]] * prime) >> shift, minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    weights: np.ndarray  # languages x DIM
    idf: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = (1 + np.log(tf)) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 without a letter or a learned language."""
        at, tf = ngrams(text)
        if not len(at) or not self.langs:
            return UND, 0.0
        logits = self.weights[:, at] @ self.vector(at, tf) / self.temperature
        p = np.exp(logits - logits.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())

    def column(self, text: Column) -> Column:
        """struct<lang, score> of a text column; invalid UTF-8 counts as its replacement characters."""
        shared = _share(self)

        @F.arrow_udf("lang string, score double")
        def of(texts: pa.Array) -> pa.Array:
            working("langid")
            model = shared.value
            found = [model.predict(t) for t in values(texts)]
            return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["lang", "score"])

        return of(valid_utf8(text))


def _share(model: LanguageModel):
    """The model has DIM weights a language, whatever the input: small enough to send to every executor."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    python_batches(spark)
    return spark.sparkContext.broadcast(model)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3, seed: int = 7) -> np.ndarray:
    """Weights (classes x DIM) after proximal updates on rows (numbers, values) in a fixed random order."""
    z, n = np.zeros((classes, DIM)), np.zeros((classes, DIM))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[:, at], n[:, at]
            w = weights(zi, ni)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = p[:, None] * x
            z[:, at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[:, at] = ni + g * g
    return weights(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature between 0.02 and 20 with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]) + 1e-4 * log_t**2)

    low, high, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per feature number and task; number -1 counts the documents."""
    working("langid")
    df, docs = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for text in values(batch.column(0)):
            at, _ = ngrams(text)
            df[at] += 1
            docs += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([docs, *df[at].tolist()], pa.int64())], names=["number", "docs"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ngrams(t) for t in values(batch.column(1))]
        ints = lambda x: pa.array([v.astype(np.int32) for v in x], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), ints(a for a, _ in found), ints(b for _, b in found), batch.column(2)], names=["lang", "numbers", "counts", "draw"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = BOUND) -> LanguageModel:
    """A model from all rows of ``labelled`` with a language; document frequencies from all, weights from about ``bound`` rows.

    Of more than LANGUAGES labels the most frequent are learned.

    Rows with null text or language are left out; rows that repeat an id and its texts are
    drawn together and count each; texts are taken whole, however long, and invalid UTF-8
    as its replacement characters. Other columns are ignored whatever their names. Without
    any row the model knows no language and predicts ``und``. The same rows give the same
    model.
    """
    python_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), valid_utf8(F.col(text_col)).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return LanguageModel((), np.zeros((0, DIM)), np.zeros(DIM), 1.0)
    counted = rows.select("text").mapInArrow(_document_frequencies, "number long, docs long").groupBy("number").agg(F.sum("docs").alias("docs")).toArrow()  # DIM rows at most
    number, seen = counted["number"].to_numpy(), counted["docs"].to_numpy()
    df = np.zeros(DIM)
    df[number[number >= 0]] = seen[number >= 0]
    idf = np.log((1 + seen[number < 0].sum()) / (1 + df)) + 1
    langs = tuple(sorted(sizes))
    each = max(1.0, bound / len(langs))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    keep = F.lit(False)
    for lang in langs:
        keep = keep | ((F.col("lang") == lang) & (draw < int((1 << 40) * min(1.0, each / sizes[lang]))))
    drawn = rows.where(keep).select("lang", "text", draw.alias("draw")).mapInArrow(_featured, "lang string, numbers array<int>, counts array<int>, draw long").orderBy("draw", "lang", "numbers").limit(2 * bound).toArrow()
    model = LanguageModel(langs, np.zeros((len(langs), DIM)), idf, 1.0)
    found = [(np.asarray(a), model.vector(np.asarray(a), np.asarray(c)), langs.index(lang)) for lang, a, c in zip(drawn["lang"].to_pylist(), drawn["numbers"].to_pylist(), drawn["counts"].to_pylist()) if a]
    held, fitted = found[::5], [r for k, r in enumerate(found) if k % 5]
    if not fitted:
        held, fitted = [], found
    if not fitted:
        return model
    w = fit_ftrl([(a, x) for a, x, _ in fitted], np.array([k for *_, k in fitted]), len(langs))
    logits = np.array([w[:, a] @ x for a, x, _ in held]).reshape(-1, len(langs))
    return LanguageModel(langs, w, idf, fit_temperature(logits, np.array([k for *_, k in held], dtype=np.int64)))
