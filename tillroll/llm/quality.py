"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, all of them. Every passage is
encoded from its own bytes and words: shares of character classes and of
each ASCII mark, word lengths, repetition. A hidden layer, a gated attention
(a tanh branch times a sigmoid branch) and a logistic output are learned together from
document labels: the attention weighs the passages, the weighted sum is the document, and
the output scores it.

The classifier is fitted on a sample of at most ``SAMPLE`` labelled documents, those of the
smallest hash of ``doc_id`` among the rows that may be learned from, and of at most ``PASSAGES`` passages together:
documents that do not fit are left out. Of an id's rows the text of the smallest hash is learned from. Labels, ``lang``,
``source`` and ``doc_id`` are no inputs of a score.

Defined results: a null or empty text is one empty passage and gets a score too. A null
``doc_id`` is not held out and has no label. Labels that are null are not used; a document
labelled several times has its mean label. Without any label every score is 0.5. Rows are scored
one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tillroll.llm.common import hash_sample, paired, small_hash, stage_table, text_hash, texts_of

PASSAGE = 1024
SAMPLE = 4096
PASSAGES = 1 << 16
"""Passages of the sample together."""

HIDDEN = 24
ATTENTION = 12
EPOCHS = 300
RATE = 0.02
DECAY = 1e-4
ACCEPT = 0.7

MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _classes() -> np.ndarray:
    """Byte by class: each mark, then upper, lower, digit, blank, line end, control, beyond ASCII."""
    table = np.zeros((256, len(MARKS) + 7), dtype=np.float64)
    for b in range(256):
        if b in MARKS:
            at = MARKS.index(b)
        else:
            kind = (65 <= b <= 90, 97 <= b <= 122, 48 <= b <= 57, b in b" \t", b in b"\r\n", b < 128)
            at = len(MARKS) + (kind.index(True) if any(kind) else 6)
        table[b, at] = 1.0
    return table


CLASSES = _classes()
FEATURES = CLASSES.shape[1] + 6


def encode(text: bytes, size: int = PASSAGE) -> np.ndarray:
    """One row of features per passage; an empty text is one passage of zeros."""
    count = max(1, -(-len(text) // size))
    out = np.zeros((count, FEATURES))
    if not text:
        return out
    lengths = np.full(count, size)
    lengths[-1] = len(text) - (count - 1) * size
    for low in range(0, count, 256):  # passages at once
        held = np.frombuffer(text[low * size : (low + 256) * size], dtype=np.uint8).astype(np.int64)
        own = min(256, count - low)
        passage = np.arange(len(held)) // size
        histogram = np.bincount(passage * 256 + held, minlength=own * 256).reshape(own, 256)
        shares = histogram @ CLASSES / lengths[low : low + own, None]
        out[low : low + own, : CLASSES.shape[1]] = np.sqrt(shares)
    for k in range(count):
        words = text[k * size : (k + 1) * size].split()
        if words:
            n = len(words)
            again = sum(map(bytes.__eq__, words, words[1:]))
            longest = max(map(len, words))
            out[k, -6:] = (
                len(set(words)) / n,
                again / n,
                (lengths[k] / n) ** 0.5,
                longest**0.5,
                n**0.5 / 16,
                1.0,
            )
    return out


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All passages, and the first one of each document."""
    encoded = [encode(t) for t in texts]
    sizes = [len(e) for e in encoded]
    return np.concatenate(encoded), np.cumsum([0, *sizes[:-1]])


class Attention:
    """Gated attention over encoded passages, in plain arrays."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        scale = 1.0 / np.sqrt(FEATURES)
        self.mean, self.spread = mean, spread
        self.weights = {
            "encode": rng.normal(0, scale, (FEATURES, HIDDEN)),
            "shift": np.zeros(HIDDEN),
            "tanh": rng.normal(0, 0.2, (HIDDEN, ATTENTION)),
            "gate": rng.normal(0, 0.2, (HIDDEN, ATTENTION)),
            "attend": rng.normal(0, 0.2, ATTENTION),
            "out": rng.normal(0, 0.2, HIDDEN),
            "bias": np.zeros(1),
        }

    def _forward(self, passages: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((passages - self.mean) / self.spread, -8, 8)
        hidden = np.tanh(x @ w["encode"] + w["shift"])
        signal, gate = np.tanh(hidden @ w["tanh"]), _sigmoid(hidden @ w["gate"])
        energy = (signal * gate) @ w["attend"]
        sizes = np.diff([*first, len(passages)])
        energy = np.exp(energy - np.repeat(np.maximum.reduceat(energy, first), sizes))
        share = energy / np.repeat(np.add.reduceat(energy, first), sizes)
        document = np.add.reduceat(share[:, None] * hidden, first, axis=0)
        score = _sigmoid(document @ w["out"] + w["bias"])
        return {
            "x": x, "hidden": hidden, "signal": signal, "gate": gate, "share": share,
            "document": document, "score": score, "sizes": sizes,
        }

    def score(self, passages: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward(passages, first)["score"]

    def gradients(
        self, passages: np.ndarray, first: np.ndarray, labels: np.ndarray
    ) -> dict[str, np.ndarray]:
        """Of the mean log loss over documents."""
        w, f = self.weights, self._forward(passages, first)
        miss = (f["score"] - labels) / len(labels)
        per = np.repeat(miss, f["sizes"])
        to_document = per[:, None] * w["out"]
        to_share = (to_document * f["hidden"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(to_share * f["share"], first), f["sizes"])
        to_energy = f["share"] * (to_share - mean)
        both = to_energy[:, None] * w["attend"]
        to_signal = both * f["gate"] * (1 - f["signal"] ** 2)
        to_gate = both * f["signal"] * f["gate"] * (1 - f["gate"])
        to_hidden = f["share"][:, None] * to_document
        to_hidden += to_signal @ w["tanh"].T + to_gate @ w["gate"].T
        inner = to_hidden * (1 - f["hidden"] ** 2)
        return {
            "encode": f["x"].T @ inner,
            "shift": inner.sum(axis=0),
            "tanh": f["hidden"].T @ to_signal,
            "gate": f["hidden"].T @ to_gate,
            "attend": (f["signal"] * f["gate"]).T @ to_energy,
            "out": f["document"].T @ miss,
            "bias": np.array([miss.sum()]),
        }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(
    passages: np.ndarray, first: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS
) -> Attention:
    """Full-batch Adam from a fixed start, so the same sample gives the same model."""
    model = Attention(passages.mean(axis=0), passages.std(axis=0) + 1e-3)
    slow = {k: np.zeros_like(v) for k, v in model.weights.items()}
    square = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for step in range(1, epochs + 1):
        for k, g in model.gradients(passages, first, labels).items():
            g = g + DECAY * model.weights[k]
            slow[k] += 0.1 * (g - slow[k])
            square[k] += 0.001 * (g * g - square[k])
            move = slow[k] / (1 - 0.9**step)
            model.weights[k] -= RATE * move / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return model


# --- over tables ------------------------------------------------------------


def remainder(modulus: int) -> Column:
    """crc32 of the id's text, by which rows are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def learnable(labels: DataFrame, label: str, modulus: int, held: int, sample: int) -> DataFrame:
    """``doc_id, label`` of at most ``sample`` labelled rows that are not held out.

    The hash bound follows the usable ids alone, so up to four times ``sample`` of them pass whole.
    """
    named = labels.where(F.col(label).isNotNull() & (remainder(modulus) != held))
    total = named.agg(F.approx_count_distinct("doc_id")).first()[0]
    few = named.where(small_hash(["doc_id"], sample, total))
    means = few.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("label"))
    return hash_sample(means, ["doc_id"], sample, total)


def sampled(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    modulus: int = 4,
    held: int = 2,
    sample: int = SAMPLE,
    passages: int = PASSAGES,
) -> list[Row]:
    """``doc_id, label, n, passages`` of the sample: one text of each chosen id, whole documents in
    the order of their ids' hash as long as they fit in ``passages``.

    What is sent is bounded by that, however many rows an id has and however long a text is.
    """
    chosen = F.broadcast(learnable(labels, label, modulus, held, sample))  # at most ``sample`` rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            counts = [max(1, -(-len(t) // PASSAGE)) for t in texts]
            rows = [
                encode(t).astype(np.float32).tobytes() if n <= passages else b""
                for t, n in zip(texts, counts, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())],
                ["doc_id", "label", "n", "passages"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "text").join(chosen, "doc_id")
    one = named.groupBy("doc_id").agg(
        F.min_by("text", text_hash()).alias("text"), F.max("label").alias("label")
    )
    held_in = stage_table(
        one.mapInArrow(features, f"doc_id {id_type}, label double, n long, passages binary"), "features"
    )
    place = F.xxhash64("doc_id").alias("place")
    left, taken = passages, []
    for r in sorted(held_in.select(place, "n").collect()):
        if r["n"] <= left:
            left -= r["n"]
            taken.append(r["place"])
    fits = held_in.where(F.xxhash64("doc_id").isin(taken)) if taken else held_in.limit(0)
    return sorted(fits.collect(), key=lambda r: r["doc_id"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    modulus: int = 4,
    held: int = 2,
    sample: int = SAMPLE,
) -> Attention | None:
    """The classifier, fitted on the driver on a sample of bounded size."""
    rows = sampled(docs, labels, label, modulus, held, sample)
    if not rows:
        return None
    held_in = [np.frombuffer(r["passages"], dtype=np.float32).reshape(r["n"], -1) for r in rows]
    first = np.cumsum([0, *[r["n"] for r in rows[:-1]]])
    return fit(np.concatenate(held_in).astype(np.float64), first, np.array([r["label"] for r in rows]))


def _scores(model: Attention | None, texts: list[bytes], slab: int = 1 << 20) -> np.ndarray:
    """Scores of a batch's texts, a slab of passages at a time."""
    if model is None:
        return np.full(len(texts), 0.5)
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= slab):
            size += len(texts[end])
            end += 1
        out.append(model.score(*bags(texts[at:end])))
        at = end
    return np.concatenate(out) if out else np.zeros(0)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    modulus: int = 4,
    held: int = 2,
    accept: float = ACCEPT,
    sample: int = SAMPLE,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    model = train(docs, labels, label, modulus, held, sample)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in paired(batches):
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids, "score": pa.array(_scores(model, texts), pa.float64())}
            )

    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {id_type}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
    )


def drop_rejected(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    modulus: int = 4,
    held: int = 2,
    accept: float = ACCEPT,
    sample: int = SAMPLE,
) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, whole."""
    model = train(docs, labels, label, modulus, held, sample)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, texts_of(batch)) >= accept))

    return docs.mapInArrow(keep, docs.schema)
