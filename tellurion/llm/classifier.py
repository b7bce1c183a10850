"""Quality classifier by compression. Operator 6.

From a bounded sample of whole labelled texts two zstandard dictionaries are trained, on good and on bad text. A document is compressed with
each; the difference of the sizes, divided by the text's length, tells which dictionary knows its kind better. A logistic curve in this one number,
fitted on labelled rows that the dictionaries were not trained on, calibrates it to the probability of label 1.

Learnt are rows with crc32(doc_id as text) mod 3 not 1 alone: of each label at most SAMPLE rows, whole, until they reach SAMPLE_BYTES. lang, source, labels and doc_id are
no inputs of a score. Null text counts as empty; empty texts get the score that the curve has for no difference. A null
doc_id is held out of nothing: held_out is false and the row isn't learnt from. Without labels of both kinds, four texts each, every score is 0.5.
Repeated rows get equal scores. Further columns are ignored, or kept by filter_documents(). Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellurion.llm import _sample, _spark, _text

#: Of each label the rows and bytes to learn from, and the size of its dictionary; the level of compression.
SAMPLE, SAMPLE_BYTES, SIZE, LEVEL = 2000, 8 << 20, 440_000, 9
#: Added to a text's length before it divides: what a frame costs by itself.
FRAME = 20


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the features, then the constant

    @property
    def key(self) -> str:
        return hashlib.sha1(self.good + b"|" + self.bad).hexdigest()


def trained(texts: list[bytes], size: int) -> bytes:
    """A dictionary of the segments that the texts share most; of too few texts, their end."""
    try:
        return zstandard.train_dictionary(size, texts, k=200, d=8, f=20, accel=1).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"\n".join(texts)[-size:]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """Of each text the bytes that the bad dictionary needs beyond the good one, for each byte of the text."""
    found = [(len(bad.compress(x)) - len(good.compress(x))) / (len(x) + FRAME) if x else 0.0 for x in texts]
    return np.array(found, float)[:, None]


def _logistic(x: np.ndarray, y: np.ndarray, pull: float = 0.5) -> np.ndarray:
    """Weights and constant, by Newton's method with halved steps where a whole one would overshoot, and a pull towards 0."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]

    def loss(w: np.ndarray) -> float:
        margin = z @ w
        return float((np.logaddexp(0, margin) - y * margin).sum() + pull / 2 * (w @ w))

    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + pull * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull * np.eye(len(w)), gradient)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * float(gradient @ step):
            size /= 2
        w -= size * step
        if np.abs(size * step).max() < 1e-9:
            break
    own = w[:-1] / scale
    return np.append(own, w[-1] - (own * mean).sum())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, level: int = LEVEL) -> Model | None:
    """None if there aren't both labels. At most 2 * sample rows come to the driver, of sample_bytes and one text for each label."""
    known = labels.where(F.col(label).isin(0, 1) & (_sample.remainder(F.col("doc_id"), 3) != 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    drawn, _ = _sample.sample(known, "y", F.col("doc_id"), sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where("text is not null").withColumn("digest", F.sha2("text", 256))  # drawn: 2 * sample rows at most
    # which texts to take is decided on their lengths, so that no more of them than are taken leave their tasks
    lengths = texts.select("doc_id", "y", "digest", F.xxhash64("text").alias("mark"), F.octet_length("text").alias("n_bytes")).distinct()
    taken = _sample.within(lengths, "y", [F.xxhash64("doc_id", F.lit("order")), F.col("mark")], sample, sample_bytes, F.col("n_bytes")).select("doc_id", "y", "digest")
    rows = texts.join(F.broadcast(_spark.cut(taken)), ["doc_id", "y", "digest"]).select("doc_id", "y", "text").distinct().collect()
    rows.sort(key=lambda r: (hashlib.sha1(str(r["doc_id"]).encode()).digest(), r["y"], r["text"]))
    kinds = {y: [r["text"].encode() for r in rows if r["y"] == y] for y in (0, 1)}
    if min(map(len, kinds.values())) < 4:
        return None
    parts = {y: (texts[: len(texts) * 6 // 10], texts[len(texts) * 6 // 10 :]) for y, texts in kinds.items()}
    # dictionaries of one size: else the larger one would know more of any text
    size = max(1024, min(SIZE, *(sum(map(len, first)) for first, _ in parts.values())))
    good, bad = (trained(parts[y][0], size) for y in (1, 0))
    x = differences(parts[1][1] + parts[0][1], _compressor(good, level), _compressor(bad, level))
    return Model(good, bad, tuple(_logistic(x, np.array([1.0] * len(parts[1][1]) + [0.0] * len(parts[0][1]))).tolist()))


_ready: dict[tuple[str, int], tuple] = _text.kept("classifier")


def _compressors(model: Model, level: int) -> tuple:
    key = (model.key, level)
    if key not in _ready:
        _ready.clear()
        _ready[key] = _compressor(model.good, level), _compressor(model.bad, level)
    return _ready[key]


def score(docs: DataFrame, model: Model | None, whole: bool = False, level: int = LEVEL) -> DataFrame:
    """doc_id and score; or score and the struct `row` of all columns."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if whole else docs.select("doc_id", "text")
    kept = docs.schema[0]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of SIZE bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.buffers(batch.column(0).field("text") if whole else batch.column(1))
            for i, j in _text.groups(offsets, 2 << 20):
                n = j - i
                if sent.value is None:
                    found = np.full(n, 0.5)
                else:
                    part = offsets[i : j + 1] - offsets[i]
                    raw = data[offsets[i] : offsets[j]].tobytes()
                    x = differences([raw[a:b] for a, b in zip(part[:-1].tolist(), part[1:].tolist())], *_compressors(sent.value, level))
                    w = np.array(sent.value.weights)
                    found = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(found)], [kept.name, "score"])

    return docs.mapInArrow(_text.tidy(run, "classifier"), T.StructType([kept, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Operator 6: doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, **parameters)
    held_out = F.coalesce(_sample.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, learn: DataFrame, labels: DataFrame, least: float = 0.5, **parameters) -> DataFrame:
    """The documents that score `least` or more, with their columns. The model is learnt from `learn`."""
    return score(docs, fit(learn, labels, **parameters), whole=True).where(F.col("score") >= least).select("row.*")
