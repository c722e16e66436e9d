"""Quality classifier: a byte convolutional network over overlapping chunks of the whole document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytecnn
from .common import labelled_sample, rested, utf8
from .langid import training_windows

#: Bytes of a chunk, and from one chunk's start to the next: neighbours share 64 bytes.
CHUNK, STEP = 512, 448
#: Bounds of the training sample: about this many texts of either label, and so many chunks of each.
TEXTS_PER_LABEL, CHUNKS_PER_TEXT = 3000, 2


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", texts_per_label: int = TEXTS_PER_LABEL, chunks_per_text: int = CHUNKS_PER_TEXT) -> bytecnn.Net | None:
    """Train on a bounded sample of the texts that `labels` (doc_id, label 0 or 1) marks; None without both labels."""
    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", label)
    raw, there, y, classes = _windows(documents, marked, label, texts_per_label, chunks_per_text)
    if len(classes) < 2:
        return None
    return bytecnn.train(raw, there, y, classes, size=CHUNK, step=STEP, fold_case=False, repeats=True, epochs=8)


def _windows(documents: DataFrame, marked: DataFrame, label: str, per_class: int, most: int):
    picked = labelled_sample(marked, label, "doc_id", per_class)
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return training_windows(texts, label, per_class * 2, CHUNK, STEP, False, most)


def score(documents: DataFrame, net: bytecnn.Net | None) -> DataFrame:
    """doc_id and score (0 to 1, the probability of good quality) of every row, from all chunks of its text.

    Chunk maxima give chunk logits; their mean, weighted by bytes, gives the document's probability. A null or
    empty text has score 0 (nothing to keep); where nothing could be learned every text has 0.5. Repeated rows
    each get their own result; other columns are not read.
    """
    texts = documents.select("doc_id", "text")
    if net is None:
        return texts.select("doc_id", F.when(F.length("text") > 0, 0.5).otherwise(0.0).alias("score"))

    def predict(batches):
        tables = net.folded()
        for rb in batches:
            data, offsets = utf8(rb.column("text"))
            logits = bytecnn.score_texts(net, tables, data, offsets)
            p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -60, 60)))
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(np.where(np.diff(offsets) > 0, p, 0.0))], ["doc_id", "score"])

    return texts.mapInArrow(rested(predict), "doc_id long, score double")


def keep(documents: DataFrame, net: bytecnn.Net | None, least: float = 0.5) -> DataFrame:
    """The rows of `documents`, with all their columns, whose text scores `least` or more."""
    if net is None:
        return documents.where(F.length("text") > 0)

    def passing(batches):
        tables = net.folded()
        for rb in batches:
            data, offsets = utf8(rb.column("text"))
            logits = bytecnn.score_texts(net, tables, data, offsets)
            p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -60, 60)))
            yield rb.filter(pa.array((p >= least) & (np.diff(offsets) > 0)))

    return documents.mapInArrow(rested(passing), documents.schema)
