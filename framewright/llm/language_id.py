"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all learnable documents, as sums over a fixed number of hashed features. The
regression is trained with follow-the-regularised-leader (proximal) and elastic-net penalties on a bounded
sample per language, calibrated with a temperature on a part of that sample it hasn't seen, and applied to every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, documents

FEATURES = 1 << 15
UNKNOWN = "und"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def gram_counts(text: str, orders: tuple = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of the whole text's character n-grams, case-folded, each hashed to one of ``FEATURES``."""
    points = code_points(text.lower()).astype(np.uint32)
    total = np.zeros(FEATURES, np.int32)
    for n in orders:
        if len(points) < n:
            break
        h = points[: len(points) - n + 1] * np.uint32(0x9E3779B1)
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[k : len(points) - n + 1 + k]
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + np.uint32(n * 0x27D4EB2F)
        total += np.bincount((h ^ (h >> np.uint32(16))) & np.uint32(FEATURES - 1), minlength=FEATURES).astype(np.int32)
    features = np.flatnonzero(total)
    return features, total[features]


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, values): (1 + log count) times inverse document frequency, to unit length."""
    features, counts = gram_counts(text)
    values = (1 + np.log(counts)) * idf[features]
    norm = np.sqrt((values * values).sum())
    return features, (values / norm if norm else values).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class FtrlSoftmax:
    """Multinomial logistic regression trained by FTRL-proximal with L1 and L2 penalties; weights stay sparse."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, features: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(features)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p[None, :]
        n = self.n[features]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[features] += g - sigma * w
        self.n[features] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search on its logarithm."""
    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    if not len(labels):
        return 1.0
    a, b, r = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """Label names, float32 weights (features x labels), inverse document frequencies, temperature."""

    def __init__(self, labels: list, weights: np.ndarray, idf: np.ndarray, heat: float):
        self.labels, self.weights, self.idf, self.heat = labels, weights, idf, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        """The label and its calibrated probability; ``und`` with 0.0 for a text that is null or has no letter."""
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        features, values = weighted(text, self.idf)
        p = softmax(values @ self.weights[features] / self.heat)
        best = int(p.argmax())
        return self.labels[best], float(min(1.0, p[best]))


def _lettered(rows: DataFrame, texts: bool) -> DataFrame:
    """The rows (label, h, text) whose text has a letter; without the text unless ``texts``."""
    def run(iterator):
        for batch in batches(iterator, "text"):
            batch = batch.filter(pa.array([has_letter(t) for t in batch.column(2).to_pylist()], pa.bool_()))
            yield batch if texts else batch.select(["label", "h"])

    return rows.mapInArrow(run, "label string, h long, text string" if texts else "label string, h long")


def _hash_bounds(rows: DataFrame, per_label: int) -> dict:
    """For each label that has a text with a letter, a text hash that at least ``per_label`` distinct texts with a letter don't exceed (if it has so many), and few more.

    Distinct hashes are counted by how far they are above the lowest hash, in eight steps to each power of two: at most
    some 500 sums a label reach the driver.
    """
    above = F.col("h").cast("double") + 2.0**63 + 1
    slot = F.floor(F.log2(above) * 8).cast("int")
    distinct = _lettered(rows.select("label", F.xxhash64("text").alias("h"), "text"), False).distinct()
    found: dict = {}
    for r in distinct.groupBy("label", slot.alias("slot")).count().collect():
        found.setdefault(r.label, []).append((r.slot, r["count"]))
    out = {}
    for name, counts in found.items():
        total, out[name] = 0, 2**63 - 1
        for at, n in sorted(counts):
            total += n
            if total >= per_label:
                # The edge is the next slot's begin, rounded upwards: it holds all that was counted.
                out[name] = min(2**63 - 1, -(2**63) + int(2.0 ** ((at + 1) / 8) * (1 + 1e-9)) + 4096)
                break
    return out


def train(docs: DataFrame, *, text: str = "text", label: str = "lang", per_label: int = 800, labels: int = 1024, epochs: int = 3) -> Model:
    """A model from labelled rows: statistics over all of them, weights from at most ``per_label`` rows of each label.

    The sample is the distinct texts (with a letter) of lowest hash of each label, so it doesn't depend on order, partitions
    or copies. Every label is learned, however rare; the fit holds half a megabyte for each, so more than ``labels`` distinct labels are
    an error (no column of languages), never dropped. Rows with a null label, or a text that is null or has no letter, teach nothing.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")

    def frequencies(iterator):
        seen, total = np.zeros(FEATURES, np.int64), 0
        for batch in batches(iterator, "text"):
            for t in batch.column(0).to_pylist():
                if has_letter(t):
                    seen[gram_counts(t)[0]] += 1
                    total += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(seen[found], total))], names=["slot", "n"])

    counts = rows.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = counts["slot"].to_numpy(), counts["n"].to_numpy()
    seen = np.zeros(FEATURES)
    seen[slot[slot >= 0]] = n[slot >= 0]
    total = max(1, int(n[slot < 0].sum()))
    idf = (np.log((1 + total) / (1 + seen)) + 0.1).astype(np.float32)

    if len(rows.select("label").distinct().limit(labels + 1).collect()) > labels:
        raise ValueError(f"more than {labels} labels")
    limit = _hash_bounds(rows, per_label)
    names = sorted(limit)
    bounds = docs.sparkSession.createDataFrame(list(limit.items()), "label string, bound long")

    # Equal texts are one before the shuffle, and only the lowest hashes are ranked: a label's ranking reads
    # little more than ``per_label`` rows, however many rows or copies there are.
    low = _lettered(rows.select("label", F.xxhash64("text").alias("h"), "text").join(F.broadcast(bounds), "label").where("h <= bound").drop("bound"), True).groupBy("label", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(W.partitionBy("label").orderBy("h"))
    sample = low.withColumn("rank", rank).where(F.col("rank") <= per_label).select("label", "h", "text")

    def featurise(iterator):
        for batch in batches(iterator, "text"):
            pairs = [weighted(t, idf) if has_letter(t) else (np.zeros(0, int), np.zeros(0, np.float32)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.astype(np.uint16).tobytes() for f, _ in pairs], pa.binary()), pa.array([v.astype(np.float16).tobytes() for _, v in pairs], pa.binary())], names=["label", "h", "features", "values"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("label", "ascending")])
        rows = {}
        for lab, h, f, v in zip(*(table.column(c).to_pylist() for c in ("label", "h", "features", "values"))):
            if f:
                rows.setdefault((h, f), (names.index(lab), np.frombuffer(f, np.uint16), np.frombuffer(v, np.float16).astype(np.float32)))
        rows = list(rows.values())
        model = FtrlSoftmax(FEATURES, len(names))
        held = [r for i, r in enumerate(rows) if i % 5 == 4]
        rest = [r for i, r in enumerate(rows) if i % 5 != 4]
        order = np.random.default_rng(1)
        for _ in range(epochs):
            for i in order.permutation(len(rest)):
                model.learn(rest[i][1], rest[i][2], rest[i][0])
        w = model.weights().astype(np.float32)
        logits = np.array([v @ w[f] for _, f, v in held]).reshape(len(held), len(names))
        heat = temperature(logits, np.array([k for k, _, _ in held], int))
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary()), "heat": [heat]})

    if not names:
        return Model([], np.zeros((FEATURES, 0), np.float32), idf, 1.0)
    fitted = sample.mapInArrow(featurise, "label string, h long, features binary, values binary").withColumn("every", F.col("h") * 0).groupBy("every").applyInArrow(fit, "weights binary, heat double").head()
    if fitted is None:
        return Model([], np.zeros((FEATURES, 0), np.float32), idf, 1.0)
    return Model(names, np.frombuffer(bytes(fitted[0]), np.float32).reshape(FEATURES, len(names)), idf, fitted[1])


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, lang_pred, score. Only the text counts; other columns are ignored.

    Null and repeated ids keep a row each, equal texts have equal predictions; labels of equal probability: the first by name. A text that is null or
    has no letter is ``und`` with 0.0, as every text is for a model that has learned nothing. Texts count whole, however long. An empty table
    gives no rows. An id has to cast to a whole number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(iterator):
        for batch in batches(iterator, "text"):
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language the model knows with at least that calibrated probability; all columns stay.

    Texts that are null, empty or without a letter go.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(iterator):
        for batch in batches(iterator, text):
            found = [shared.value.predict(t) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id="doc_id"):
    """The fold that nothing is learned from: crc32 of the id as text, modulo 3, is 1. A null id isn't in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may teach: those with an id outside the held-out fold."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out())


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of all documents: doc_id, held_out, lang_pred, score."""
    docs = documents(spark, sf_dir)
    return predict(docs, train(learnable(docs))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
