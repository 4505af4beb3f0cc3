"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A labelled document of the better class is preferred to one of the worse. P(a before b) is
sigmoid(w . (f(a) - f(b))), and w is fitted by Newton steps on the logistic loss of the pairs' feature
differences. The utility w . f(x) is cut at a quantile of the training utilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.llm.arrow import map_rows
from sonarium.llm.storage import bounded_batches

FEATURES = ("log_words", "word_length", "distinct_words", "adjacent_repeats", "upper", "digits", "symbols", "bangs", "bars", "stops", "line_repeats", "line_length", "symbol_words", "shout_words", "top_word", "long_words")
_SYMBOL_END = re.compile(r"[#$%&*@^~|<>{}=+\\/_\[\]!]+[.,]?(?:\s|$)")


def text_features(text: str) -> list[float]:
    """Shape of a text by shares, without regard to its language. A text without words has zeros throughout."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, int(counts.sum() - counts[9:14].sum() - counts[32]))
    upper = sum(map(str.isupper, words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum() - counts[44] - counts[46])
    return [
        float(np.log1p(n)), min(20.0, size / n), len(seen) / n**0.85, repeats / n, counts[65:91].sum() / size, counts[48:58].sum() / size, symbols / size, counts[33] / n, counts[124] / n,
        min(1.0, (counts[44] + counts[46]) / n), 1 - len(set(lines)) / len(lines), min(50.0, n / len(lines)), len(_SYMBOL_END.findall(text)) / n, upper / n, max(seen.values()) / n, sum(len(w) > 16 for w in words) / n,
    ]


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and features (array of double) of every row; null texts count as empty."""

    def rows(batches):
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                yield (key.as_py(), text_features(value.as_py() or "")), 200

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), rows, "doc_id LONG, features ARRAY<DOUBLE>")


@dataclass
class PairwiseModel:
    """Standardised weights, and the utility at which documents are cut (score 0.3)."""

    mean: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    scale: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    cut: float = 0.0
    accuracy: float | None = None

    def utility(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -8, 8)
        return z @ np.array(self.weights)


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = 40_000, penalty: float = 1e-3, seed: int = 7) -> PairwiseModel:
    """Fits the weights on random preference pairs, and chooses the quantile of the training utilities with the best balanced accuracy. Without both classes all utilities are equal."""
    if not good.any() or good.all():
        return PairwiseModel()
    model = PairwiseModel(x.mean(0).tolist(), np.where(x.std(0) > 1e-9, x.std(0), 1.0).tolist())
    z = np.clip((x - np.array(model.mean)) / np.array(model.scale), -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    d = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        grad = d.T @ (p - 1) / pairs + penalty * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w)), grad)
        w -= step * min(1.0, 4 / max(4e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w.tolist()
    u = model.utility(x)
    order = np.argsort(u, kind="stable")
    below_bad = np.concatenate([[0], np.cumsum(~good[order])]) / len(worse)
    below_good = np.concatenate([[0], np.cumsum(good[order])]) / len(better)
    gain = below_bad - below_good
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = int(best[len(best) // 2])
    ranked = u[order]
    model.cut = float((ranked[max(0, k - 1)] + ranked[min(k, len(ranked) - 1)]) / 2)
    model.accuracy = float((1 + gain[k]) / 2)
    return model


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never learnt from: crc32 of the id as text is a multiple of 5, or the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> PairwiseModel:
    """Learns from at most `sample` labelled rows of each class, chosen by a hash of their id; held-out rows take no part.

    The sample's ids are broadcast, and their features come to the driver: they are 2 * sample at most. An id with
    contradictory labels counts as its worse one; of rows that repeat an id, the text whose hash is smallest counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")).select("doc_id", "first.text")
    got = features(one).join(F.broadcast(chosen), "doc_id").select("doc_id", "features", "quality").collect()
    if not got:
        return PairwiseModel()
    got.sort(key=lambda r: (r.doc_id, r.features))
    return fit_pairs(np.array([r.features for r in got]), np.array([r.quality == 1 for r in got]))


def score(docs: DataFrame, model: PairwiseModel, cut_score: float = 0.3) -> DataFrame:
    """doc_id and score (0 to 1, the cut at cut_score) of every row, from its text alone."""
    base = float(np.log(cut_score / (1 - cut_score)))

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([text_features(t or "") for t in part.column(1).to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(model.utility(x) - model.cut + base, -40, 40)))
                for key, value in zip(part.column(0).to_pylist(), s.tolist(), strict=True):
                    yield (key, value), 16

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, "doc_id LONG, score DOUBLE")


def classify(docs: DataFrame, labels: DataFrame, cut_score: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, repeated ones too; null texts count as empty. With no labels at all every score is cut_score, and all are predicted 1."""
    return score(docs, train(docs, labels), cut_score).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut_score).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut_score: float = 0.3) -> DataFrame:
    """The rows of docs, whole and unchanged, whose score reaches cut_score; scored in the pass that reads them.

    Null and empty texts have the score of a text without words; without labels all rows stay. Repeated rows and
    rows of a null id are judged by their text like all others, and other columns may have any name."""
    bounded_batches(docs.sparkSession)
    model = train(docs, labels)
    base = float(np.log(cut_score / (1 - cut_score)))
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = np.array([text_features(t or "") for t in part.column(at).to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(model.utility(x) - model.cut + base, -40, 40)))
                yield part.filter(pa.array(s >= cut_score))

    return docs.mapInArrow(run, docs.schema)
