"""Quality classifier by compression with dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.samples import class_sample

#: Documented bound of what is learned from: rows of each class, whose texts are taken whole.
TEXTS_PER_CLASS = 2000
#: Pairs of dictionaries: their bytes, and those of the stretches that they compress.
SETS = ((64 << 10, 2048), (112 << 10, 512), (8 << 10, 2048), (112 << 10, 256), (16 << 10, 128))


def chunks(text: bytes, size: int) -> list[bytes]:
    """Equal stretches of a text of about ``size`` bytes, so that a dictionary helps all of a long text."""
    n = max(1, round(len(text) / size))
    step = -(-len(text) // n) or 1
    return [text[i : i + step] for i in range(0, len(text), step)] or [b""]


class QualityModel:
    """Pairs of dictionaries, and a logistic curve from compressed-size differences to a probability.

    Of each class half of the sample trains the dictionaries, the other half the curve.  A feature is a
    difference of the sizes under the two dictionaries of a pair: over the whole text, by its length and by the smaller
    size, and by the smaller size in the stretch that speaks most for bad, most for good, and in the median one.
    The curve's constant is moved from the sample's shares of the classes to those of all labelled rows
    (``counts``: of good, of bad), so it doesn't depend on how many of each were drawn.
    """

    def __init__(self, good: list[str], bad: list[str], counts: tuple[int, int] | None = None, sets: tuple[tuple[int, int], ...] = SETS):
        texts = [[t.encode() for t in c] for c in (good, bad)]
        self.sizes = [chunk for _, chunk in sets]
        self.raw = [[self._dictionary([c for t in own[::2] for c in chunks(t, chunk)], size) for own in texts] for size, chunk in sets]
        self._ready()
        rows = [self.features(t) for own in texts for t in own[1::2]]
        labels = np.array([1.0] * len(texts[0][1::2]) + [0.0] * len(texts[1][1::2]))
        x = np.array(rows).reshape(-1, 5 * len(sets))
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.scale = x.std(0) + 1e-9 if len(x) else np.ones(x.shape[1])
        self.weights = self._fit(self._standard(x), labels)
        n_good, n_bad = counts or (len(good), len(bad))
        if labels.sum() and labels.sum() < len(labels) and n_good and n_bad:
            self.weights[0] += np.log(n_good / n_bad) - np.log(labels.sum() / (len(labels) - labels.sum()))

    @staticmethod
    def _dictionary(samples: list[bytes], size: int) -> bytes:
        try:
            return zstandard.train_dictionary(size, samples, level=3).as_bytes()
        except zstandard.ZstdError:  # too few samples to choose from: their text itself
            return b"".join(samples)[-size:] or b" " * 8

    def _ready(self) -> None:
        make = lambda raw: zstandard.ZstdCompressor(level=3, dict_data=self._as_dict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.zips = [[make(raw) for raw in pair] for pair in self.raw]

    @staticmethod
    def _as_dict(raw: bytes) -> zstandard.ZstdCompressionDict:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=3)
        return d

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "zips"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _standard(self, x: np.ndarray) -> np.ndarray:
        """Features in deviations from their means, three at most: a copy of training text lies far out."""
        return np.clip((x - self.mean) / self.scale, -3, 3)

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
        """Logistic regression with equal weight for the classes' shares as they are; Newton's method."""
        x = np.hstack([np.ones((len(x), 1)), x])
        w = np.zeros(x.shape[1])
        if not len(y):
            return w
        penalty = ridge * np.eye(len(w))
        penalty[0, 0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def features(self, text: bytes) -> list[float]:
        out: list[float] = []
        for (good, bad), size in zip(self.zips, self.sizes, strict=True):
            parts = chunks(text, size)
            sizes = np.array([(len(good.compress(p)), len(bad.compress(p))) for p in parts], float)
            difference, smaller = sizes[:, 1] - sizes[:, 0], sizes.min(1)
            shares = difference / smaller
            out += [difference.sum() / max(1, len(text)), difference.sum() / smaller.sum(), shares.min(), shares.max(), float(np.median(shares))]
        return out

    def score(self, text: bytes | None) -> float:
        x = self._standard(np.array(self.features(text or b"")))
        z = float(self.weights[0] + x @ self.weights[1:])
        return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, z)))))


def train_quality(rows: DataFrame, label: str = "quality", per_class: int = TEXTS_PER_CLASS) -> QualityModel:
    """A model from ``rows`` (doc_id, text, ``label`` 1 for good or 0 for bad), from about ``per_class`` whole texts of each.

    Rows with another or a null label, or a null text, teach nothing; without rows of both classes all scores are near those of the one there is.
    """
    texts, counts = class_sample(rows.withColumn("_int", F.col(label).cast("int")).filter(F.col("_int").isin(0, 1)), "_int", per_class)
    return QualityModel(texts.get(1, []), texts.get(0, []), (counts.get(1, 0), counts.get(0, 0)))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score of every whole text of ``docs`` (doc_id, text): the probability of label 1.

    A null text is scored as an empty one.  Equal texts and repeated rows get equal scores, whatever their
    other columns; texts of any length are compressed whole, stretch by stretch.  An empty table gives no rows.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries of fixed sizes

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(score, "doc_id long, score double")


def filter_quality(docs: DataFrame, model: QualityModel, least: float) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with all their columns; a null text is scored as an empty one."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries of fixed sizes
    at = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.encode() if isinstance(t := v.as_py(), str) else t) >= least for v in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
