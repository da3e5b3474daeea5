"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the n-grams of 1 to 3 code points of the lower-cased text, hashed to ``N_FEATURES`` columns, weighted by
``(1 + log tf) * idf`` and scaled to length 1. The document frequencies behind ``idf`` count all learning documents.
The weights are trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, which leaves most
of them exactly zero; a temperature fitted on a part of the sample that training does not see calibrates the scores.

The model is fitted on a bounded sample: about ``SAMPLE`` distinct learning documents in all, shared out evenly over the
languages (one each at least: the one of least hash), chosen by hash, whole texts. Everything else covers all rows and every
label. The workers are sent at most ``WEIGHTS`` weights of 4 or 8 bytes: with more than ``WEIGHTS / N_FEATURES`` languages the
n-grams are hashed to fewer columns. With more than ``ACTIVE`` languages a training step updates those whose probability it
changes by ``LEAST`` or more.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no labelled learning document
every text is ``und``. Null or unknown labels are not learned from. Equal texts get equal predictions. Very long texts
are counted in pieces, whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, table

N_FEATURES = 1 << 14
WEIGHTS = 1 << 24
SAMPLE = 2_400
ACTIVE, LEAST = 64, 1e-4
UNDETERMINED = "und"
ORDERS = (1, 2, 3)
#: Code points counted at a time.
PIECE = 1_000_000


def counts(text: str, features: int = N_FEATURES) -> np.ndarray:
    """How often each hashed n-gram stands in the text, as an array of that many features (a power of two)."""
    out = np.zeros(features, np.int64)
    low = text.lower()
    for k in range(0, max(len(low), 1), PIECE):
        piece = low[k : k + PIECE + max(ORDERS) - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        for n in ORDERS:
            m = min(len(codes) - n + 1, PIECE)
            if m <= 0:
                continue
            mixed = np.full(m, n, np.uint64)
            for j in range(n):
                mixed = (mixed ^ codes[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            out += np.bincount((mixed >> np.uint64(40)).astype(np.int64) & (features - 1), minlength=features)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def weigh(index: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of length 1 for the given features."""
    x = (1.0 + np.log(tf)) * idf[index]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, index: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[index] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not has_letter(text):
            return UNDETERMINED, 0.0
        c = counts(text, len(self.idf))
        index = np.flatnonzero(c)
        z = self.logits(index, weigh(index, c[index], self.idf)) / self.temperature
        p = softmax(z)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4, features: int = N_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (features, values); returns weights and bias."""
    kind = np.float64 if n_classes <= ACTIVE else np.float32
    z, n, weights = (np.zeros((features, n_classes), kind) for _ in range(3))
    zb, nb, bias = (np.zeros(n_classes) for _ in range(3))

    def of(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order, every = np.random.default_rng(7), np.arange(n_classes)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            index, x = rows[k]
            g = softmax(x @ weights[index] + bias)
            g[labels[k]] -= 1.0
            active = every if n_classes <= ACTIVE else np.flatnonzero(np.abs(g) >= LEAST)
            at, ga = np.ix_(index, active), g[active]
            w, ni, gw = weights[at], n[at], x[:, None] * ga
            z[at] += gw - (np.sqrt(ni + gw * gw) - np.sqrt(ni)) / alpha * w
            n[at] = ni + gw * gw
            weights[at] = of(z[at], n[at], l1)
            zb[active] += ga - (np.sqrt(nb[active] + ga * ga) - np.sqrt(nb[active])) / alpha * bias[active]
            nb[active] += ga * ga
            bias[active] = of(zb[active], nb[active], 0.0)
    return weights, bias


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _frequencies(batches: Iterator[pd.DataFrame], features: int) -> Iterator[pd.DataFrame]:
    df, docs = np.zeros(features, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            df += counts(text, features) > 0
            docs += 1
    if docs:
        yield pd.DataFrame({"feature": np.arange(-1, features), "n": np.concatenate([[docs], df])})


def _features(batches: Iterator[pd.DataFrame], features: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for text in batch["text"]:
            c = counts(text, features)
            index = np.flatnonzero(c)
            found.append((index.astype("<u2").tobytes(), c[index].astype("<u4").tobytes()))
        yield pd.DataFrame({"lang": batch["lang"], "held": batch["held"], "first": batch["first"], "mixed": batch["mixed"], "feature": [a for a, _ in found], "tf": [b for _, b in found]})


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the columns ``text`` and ``lang`` of ``docs``; rows with a null in one of them are passed over."""
    given = docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("mixed", F.xxhash64("text"))
    sizes = given.groupBy("lang").agg(F.count("*").alias("n"), F.min("mixed").alias("least"))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())  # a row for each label
    if not languages:
        return Model([], np.zeros(N_FEATURES), np.zeros((N_FEATURES, 0)), np.zeros(0))
    features = N_FEATURES
    while features * len(languages) > WEIGHTS and features > 64:
        features //= 2
    each = max(1, sample // len(languages))
    # A hash of the text below a threshold for each language: about `each` rows, without ranking any group.
    share = F.least(F.lit(1.0), F.lit(float(each)) / F.col("n"))
    below = F.pmod("mixed", F.lit(1_000_003)) < F.ceil(share * 1_000_003)
    first = F.col("mixed") == F.col("least")
    chosen = given.join(F.broadcast(sizes), "lang").where(below | first).dropDuplicates(["lang", "mixed"])
    chosen = chosen.select("lang", "text", "mixed", (~first & (F.pmod(F.shiftright("mixed", 40), F.lit(5)) == 0)).alias("held"), first.alias("first"))
    counted = chosen.mapInPandas(lambda b: _features(b, features), "lang string, held boolean, first boolean, mixed long, feature binary, tf binary")
    rows = counted.orderBy(F.desc("first"), "mixed", "lang").limit(2 * sample + len(languages)).collect()
    df = given.select("text").mapInPandas(lambda b: _frequencies(b, features), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(features + 1)
    for r in df:
        seen[r["feature"] + 1] = r["n"]
    idf = np.log((1.0 + seen[0]) / (1.0 + seen[1:])) + 1.0
    code = {x: i for i, x in enumerate(languages)}

    def ready(held: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        own = [r for r in rows if r["held"] == held]
        xs = [(index := np.frombuffer(r["feature"], "<u2").astype(np.int64), weigh(index, np.frombuffer(r["tf"], "<u4"), idf)) for r in own]
        return xs, np.array([code[r["lang"]] for r in own], np.int64)

    xs, ys = ready(False)
    weights, bias = train(xs, ys, len(languages), features=features)
    model = Model(languages, idf, weights, bias)
    xs, ys = ready(True)
    if len(xs):
        model.temperature = fit_temperature(np.array([model.logits(i, x) for i, x in xs]), ys)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.drop("lang_pred", "score")
    kept = [c for c in given.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = [shared.value.predict(t) for t in part.column(text).to_pylist()]
                columns = [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], [*kept, "lang_pred", "score"])

    fields = ", ".join(f"`{n}` {t}" for n, t in given.dtypes if n != text)
    return given.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, by a model that has not seen the held-out ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)


QUERIES = {"op2_language_id": op2_language_id}
ORACLE_SQL: dict[str, str] = {}
