"""Language identification with a byte convolutional network over fixed-length windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytecnn
from .common import labelled_sample, rested, utf8

#: Bytes of a window; windows of a text follow each other and cover it.
WINDOW = 256
#: Bounds of the training sample: about this many texts a language, and so many windows of each.
TEXTS_PER_LANGUAGE, WINDOWS_PER_TEXT = 800, 3
UNDETERMINED = "und"


def training_windows(documents: DataFrame, label: str, per_class: int, size: int, step: int, fold_case: bool, most: int):
    """Windows of a bounded sample of labelled texts: (bytes, presence, label index, sorted label values).

    `documents` has doc_id, text and the label. The driver gets 2 * per_class * `most` windows a class at most.
    """
    picked = labelled_sample(documents, label, "doc_id", per_class)

    def windows(batches):
        for rb in batches:
            doc, raw, there = bytecnn.sampled_windows(*utf8(rb.column("text")), size, step, fold_case, most)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id").take(pa.array(doc)), rb.column("label").take(pa.array(doc)), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(there.sum(1).astype(np.int32))], ["doc_id", "label", "bytes", "n"])

    texts = documents.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("string").alias("label"), "text")
    texts = texts.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id")
    got = texts.mapInArrow(rested(windows), "doc_id long, label string, bytes binary, n int").toPandas().sort_values(["doc_id", "label", "bytes"])
    classes = sorted(got["label"].unique())
    raw = np.frombuffer(b"".join(got["bytes"]), np.uint8).reshape(len(got), size + bytecnn.TAIL)
    there = np.arange(size + bytecnn.TAIL) < got["n"].to_numpy()[:, None]
    return raw, there, np.searchsorted(classes, got["label"]) if classes else np.zeros(0, int), classes


def fit(documents: DataFrame, label: str = "lang", texts_per_language: int = TEXTS_PER_LANGUAGE, windows_per_text: int = WINDOWS_PER_TEXT) -> bytecnn.Net | None:
    """Train on a bounded sample of `documents` (doc_id, text, label); None where no row has a label."""
    raw, there, y, classes = training_windows(documents, label, texts_per_language, WINDOW, WINDOW, True, windows_per_text)
    return bytecnn.train(raw, there, y, classes, size=WINDOW, step=WINDOW, fold_case=True, repeats=False) if classes else None


def identify(documents: DataFrame, net: bytecnn.Net | None) -> DataFrame:
    """doc_id, lang_pred, score of every row, from all windows of its text and nothing else.

    A text that is null, empty or without a letter is `und` with score 0; so is every text where nothing could be
    learned. Repeated rows each get their own result; other columns of `documents` are not read.
    """
    texts = documents.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if net is None:
        return texts.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def predict(batches):
        tables = net.folded()
        for rb in batches:
            logits = bytecnn.score_texts(net, tables, *utf8(rb.column("text")))
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            there = rb.column("text").is_valid().to_numpy(zero_copy_only=False)
            names = [net.classes[k] if ok else UNDETERMINED for k, ok in zip(best, there, strict=True)]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(there, p[np.arange(len(p)), best], 0.0))], ["doc_id", "lang_pred", "score"])

    return texts.mapInArrow(rested(predict), "doc_id long, lang_pred string, score double")
