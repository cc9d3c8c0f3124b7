"""Quality scores from two compressors.

One zstandard dictionary is built from text labelled good and one from text
labelled bad. A text is cut into blocks, each block is compressed with either
dictionary, and the difference of the summed sizes, bad - good, is normalised
by the text's size. It becomes a probability by a logistic curve fitted on
labelled rows that built neither dictionary. Short texts tell little, so the size
is lengthened by a number of bytes before it divides; that number (of PADS) and the
weight of a short text's lead towards either label are fitted with the curve.

Training rows are a bounded, documented sample: for each class the `sample`
ids of lowest hash, as far as their texts stay within `sample_bytes`; two of three
build the dictionary and the third calibrates. A repeated id gives its text of
lowest hash, so reruns and other partitions give the same model. Everything else
covers all data. Pieces of training text under 16 bytes, which the dictionary
builder can't take, are joined to the piece before them or left out.

Defined results: null, empty and untrained cases get the share of label 1 among
the labels learnt from (0.5 without any). Null labels and null ids are not learnt
from; an id labelled both ways is not either. Repeated rows give repeated
results. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zephyrframe.llm.common import materialize

#: Bytes by which sizes may be lengthened before they divide.
PADS = (0.0, 50.0, 100.0, 200.0, 400.0, 800.0)


@dataclass(frozen=True)
class CompressionModel:
    """Both dictionaries and the curve: score = 1 / (1 + exp(-(bias + (slope * difference + lead) / (size + pad))))."""

    good: bytes
    bad: bytes
    bias: float
    slope: float
    prior: float
    block: int = 512
    level: int = 3
    lead: float = 0.0
    pad: float = 0.0


class Scorer:
    """Scores texts with a model."""

    def __init__(self, model: CompressionModel):
        self.model = model
        self.compress = [self._compressor(d, model.level) for d in (model.good, model.bad)] if model.good and model.bad else []

    @staticmethod
    def _compressor(content: bytes, level: int):
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, text: str) -> tuple[int, int] | None:
        """The difference of compressed sizes, bad - good, and the size; None for an empty text."""
        raw, block = text.encode(), self.model.block
        if not raw or not self.compress:
            return None
        blocks = [raw[i : i + block] for i in range(0, len(raw), block)]
        good, bad = (sum(len(f(b)) for b in blocks) for f in self.compress)
        return bad - good, len(raw)

    def score(self, text: str) -> float:
        """The probability of label 1."""
        found, m = self.sizes(text), self.model
        if found is None:
            return m.prior
        return float(1 / (1 + np.exp(-np.clip(m.bias + (m.slope * found[0] + m.lead) / (found[1] + m.pad), -500, 500))))


def fit_curve(features: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights (bias first) of a logistic curve by Newton's method, slightly ridged so separable rows have one too; and its loss."""
    scale = features.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.concatenate([np.ones((len(y), 1)), features / scale], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    at = np.clip(z @ w, -30, 30)
    loss = float(np.mean(np.log1p(np.exp(-np.where(y > 0, at, -at)))))
    return np.concatenate((w[:1], w[1:] / scale)), loss


def calibrate(difference: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """bias, slope, lead and pad of the curve with the least loss; of equal ones the smallest pad."""
    best = None
    for pad in PADS:
        w, loss = fit_curve(np.stack([difference / (size + pad), 1.0 / (size + pad)], axis=1), y)
        if best is None or loss < best[0] - 1e-9:
            best = (loss, float(w[0]), float(w[1]), float(w[2]), pad)
    return best[1:]


def build_dictionary(texts: list[bytes], size: int, piece: int = 2048) -> bytes:
    """A dictionary from texts; too little text gives the text itself as content."""
    samples = []
    for t in texts:
        cut = [t[i : i + piece] for i in range(0, len(t), piece)]
        if len(cut) > 1 and len(cut[-1]) < 16:
            cut[-2:] = [cut[-2] + cut[-1]]
        samples += [x for x in cut if len(x) >= 16]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 2000, sample_bytes: int = 16_000_000, dictionary: int = 49152, block: int = 512, level: int = 3) -> CompressionModel:
    """A model from the labelled rows for which `learn_from`, a condition on the id, holds.

    The driver gets at most 2 * sample ids and sizes, then at most 2 * sample_bytes of text.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learn_from)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("label")).filter("low = label")
    known = known.select("id", "label", F.xxhash64(F.lit("sample"), "id").alias("order"))
    picked = known.filter("label = 0").orderBy("order", "id").limit(sample).unionByName(known.filter("label = 1").orderBy("order", "id").limit(sample))
    # At most 2 * sample rows of three numbers, so the join with all documents may broadcast them.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    # One scan: of each picked id one text, written once, so that sizes and texts are those of the same rows.
    one = texts.join(F.broadcast(picked), "id").groupBy("id", "label", "order").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))
    joined = materialize(one.select("id", "label", "order", F.col("row.text").alias("text")), 2 * sample)
    within = Window.partitionBy("label").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0)
    sized = joined.select("id", "label", "order", F.octet_length("text").alias("size")).withColumn("upto", F.sum("size").over(within)).filter(F.col("upto") <= sample_bytes)
    rows = joined.join(F.broadcast(sized.select("id")), "id", "left_semi").select("label", "order", "id", "text").collect()
    if not rows:
        return CompressionModel(b"", b"", 0.0, 0.0, 0.5, block, level)
    by: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r["order"], r["id"])):
        by[r["label"]].append(r["text"].encode())
    built = {k: build_dictionary([t for n, t in enumerate(v) if n % 3], dictionary) if v else b"" for k, v in by.items()}
    total = known.groupBy("label").count().collect()
    counts = {r["label"]: r["count"] for r in total}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    model = CompressionModel(built[1], built[0], 0.0, 0.0, prior, block, level)
    scorer = Scorer(model)
    held = [(scorer.sizes(t.decode()), k) for k, v in by.items() for n, t in enumerate(v) if not n % 3]
    held = [(*found, k) for found, k in held if found is not None]
    if not held:
        return model
    difference, size, y = np.array(held, float).T
    bias, slope, lead, pad = calibrate(difference, size, y)
    # The sample takes both classes alike; the bias is moved to the classes' true shares.
    share = float(y.mean())
    if 0 < share < 1 and 0 < prior < 1:
        bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return CompressionModel(built[1], built[0], float(bias), slope, prior, block, level, lead, pad)


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score for each row, from its whole text; no shuffle."""
    # Broadcast values are pickled by reference to their classes, so only plain ones are sent.
    held = docs.sparkSession.sparkContext.broadcast(astuple(model))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(CompressionModel(*held.value))
        for batch in batches:
            scores = [scorer.score(v.as_py() or "") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
