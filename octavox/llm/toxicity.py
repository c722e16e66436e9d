"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Lexicon and pattern voters vote on the sampled texts. The label model knows their votes only: it estimates each
voter's accuracy and the voters' correlations from how they agree, by expectation-maximisation, and gives every text
a posterior label. Gold labels choose the words of the lexicons and the share of toxic texts; they are no voter, start
no posterior and are not what the classifier learns.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

#: Bound of the training sample: about this many texts of either label.
TEXTS_PER_LABEL = 2500
#: Voters made from induced word lists, entries of all lists together, texts an entry must be in at least, and how much more often in toxic ones.
LEXICONS, ENTRIES, LEAST_TEXTS, LEAST_LIFT = 12, 480, 4, 8.0
#: Lengths of word beginnings that may be entries besides whole words.
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose entries a worker keeps, and entries that it counts before it hands the counts on.
KEPT_WORDS, COUNTED = 400_000, 200_000


def entries_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def patterns(text: str) -> list[bool]:
    """Votes of the pattern voters: shouting, strings of exclamation marks, second-person openings, starred letters."""
    return [
        len(re.findall(r"\b[A-ZÀ-Þ]{4,}\b", text)) >= 3,
        re.search(r"!{2,}|[!?]{3,}", text) is not None,
        re.search(r"(?i)\b(you|du|tu|usted|vous)\b\W+(are|bist|es|eres|êtes)\b", text) is not None,
        re.search(r"\b\w+\*{2,}\w*", text) is not None,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class LabelModel:
    """P(votes | label): how often each voter speaks up for either label, and how the voters correlate within a label.

    A voter's evidence is the log ratio of its rates. Voters that go together share theirs: their shares solve
    C s = 1 for the correlations C, so that two voters who always agree count as one.
    """

    prior: float
    rates: np.ndarray  # (2, voters): P(vote | label)
    correlation: np.ndarray
    shares: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> LabelModel:
        """Expectation-maximisation on the votes alone, from a first guess of the posteriors made of votes."""
        posterior = np.clip(start, 0.02, 0.98)
        model = cls(prior, np.zeros((2, votes.shape[1])), np.eye(votes.shape[1]), np.ones(votes.shape[1]))
        for _ in range(rounds):
            weights = np.stack([1 - posterior, posterior])
            # Half a vote more on either side, so that a voter that never errs in the sample isn't taken as infallible.
            rates = (weights @ votes + 0.5) / (weights.sum(1, keepdims=True) + 1)
            spread = sum(((votes - rates[k]) * weights[k][:, None]).T @ (votes - rates[k]) for k in (0, 1)) / max(1, len(votes))
            sd = np.sqrt(np.maximum(np.diag(spread), 1e-9))
            correlation = spread / np.outer(sd, sd)
            # Exclusion (negative correlation) gives no voter more than its own evidence.
            together = np.maximum(correlation, 0) + ridge * np.eye(len(sd))
            shares = np.clip(np.linalg.solve(together, np.ones(len(sd))) * (1 + ridge), 0.1, 1)
            model = cls(prior, rates, correlation, shares)
            after = model.posterior(votes)
            done = np.abs(after - posterior).max(initial=0) < 1e-6
            posterior = after
            if done:
                break
        return model

    def posterior(self, votes: np.ndarray, prior: float | None = None) -> np.ndarray:
        prior = self.prior if prior is None else prior
        spoke, silent = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        return _sigmoid(np.log(prior / (1 - prior)) + votes @ (self.shares * spoke) + (1 - votes) @ (self.shares * silent))

    def accuracies(self) -> np.ndarray:
        return self.prior * self.rates[1] + (1 - self.prior) * (1 - self.rates[0])


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float
    label_model: LabelModel | None = None


def first_guess(votes: np.ndarray, lexicons: int, prior: float) -> np.ndarray:
    """Posteriors to start from: the share `prior` of the texts with the most lexicon votes, ties alike."""
    count = votes[:, :lexicons].sum(1) + 0.1 * votes[:, lexicons:].sum(1)
    most = np.sort(count)[::-1][min(len(count) - 1, int(prior * len(count)))] if len(count) else 0
    return np.where(count > most, 0.9, np.where((count == most) & (count > 0), 0.7, 0.1))


def induce(texts: DataFrame, n0: int, n1: int) -> list[str]:
    """Word-list entries that toxic training texts (`text`, `gold`) hold far more often than others, best first.

    Texts are counted where they are; the driver gets ENTRIES rows at most.
    """

    def count(batches):
        for part in batches:
            total, toxic = Counter(), Counter()
            for begin in range(len(part)):
                own = {e for w in words_of(part["text"].iat[begin]) for e in entries_of(w)}
                total.update(own)
                if part["gold"].iat[begin] == 1:
                    toxic.update(own)
                if len(total) > COUNTED or begin == len(part) - 1:
                    yield pd.DataFrame({"entry": list(total), "n": list(total.values()), "k": [toxic[e] for e in total]})
                    total, toxic = Counter(), Counter()

    counts = texts.select("text", "gold").mapInPandas(count, "entry string, n long, k long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    lift = ((F.col("k") + 0.5) / float(max(1, n1))) / ((F.col("n") - F.col("k") + 0.5) / float(max(1, n0)))
    best = counts.where(F.col("k") >= LEAST_TEXTS).withColumn("lift", lift).where(F.col("lift") >= LEAST_LIFT)
    return [r["entry"] for r in best.orderBy(F.desc(F.col("k") * F.log("lift")), "entry").limit(ENTRIES).collect()]


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", texts_per_label: int = TEXTS_PER_LABEL) -> Classifier | None:
    """Learn from a bounded sample of the texts that `labels` (doc_id, label 0 or 1) marks; None without both labels.

    Gold labels pick the entries of the word lists and give the share of toxic texts; the label model sees votes
    only and the classifier sees its posteriors only. The driver gets 4 * texts_per_label rows of votes and of the
    places of the entries that a text has, at most.
    """
    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", label)
    counts = dict(marked.groupBy(label).count().collect())
    if len(counts) < 2:
        return None
    picked = labelled_sample(marked, label, "doc_id", texts_per_label)
    texts = documents.select("doc_id", "text").join(F.broadcast(picked.withColumnRenamed(label, "gold")), "doc_id")
    sampled = {r["gold"]: r["count"] for r in texts.groupBy("gold").count().collect()}
    if len(sampled) < 2:
        return None
    chosen = induce(texts, sampled[0], sampled[1])
    index = {e: k for k, e in enumerate(chosen)}

    def features(batches):
        for part in batches:
            part["entries"] = [sorted({index[e] for w in words_of(t) for e in entries_of(w) if e in index}) for t in part["text"]]
            part["votes"] = [patterns(t or "") for t in part["text"]]
            yield part[["doc_id", "entries", "votes"]]

    got = texts.select("doc_id", "text").mapInPandas(features, "doc_id long, entries array<int>, votes array<boolean>").toPandas()
    got = got.assign(held=[tuple(e) for e in got["entries"]]).sort_values(["doc_id", "held"], ignore_index=True)
    x = np.zeros((len(got), len(chosen)), np.float32)
    for row, own in zip(x, got["held"], strict=True):
        row[list(own)] = 1
    lexicons = min(LEXICONS, len(chosen))
    votes = np.column_stack([*(x[:, k::LEXICONS].any(1) for k in range(lexicons)), np.array(got["votes"].tolist(), bool)]).astype(float)
    share = sampled[1] / (sampled[0] + sampled[1])
    model = LabelModel.fit(votes, share, first_guess(votes, lexicons, share))
    prior = float(np.clip(counts[1] / sum(counts.values()), 0.01, 0.99))
    weights, bias = logistic(x, model.posterior(votes, prior))
    return Classifier({e: float(w) for e, w in zip(chosen, weights, strict=True) if w}, float(bias), model)


def logistic(x: np.ndarray, posterior: np.ndarray, rounds: int = 400, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that fit soft labels; weights of entries, signs of toxicity all, stay non-negative."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for turn in range(1, rounds + 1):
        error = _sigmoid(x @ w + b) - posterior
        g = np.append(x.T @ error / len(x) + ridge * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8) * (1 - turn / (rounds + 1))
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return w, b


def score(documents: DataFrame, classifier: Classifier | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row, from all words of its text.

    An entry counts once a text. A null or empty text has the score of a text without entries; where nothing could
    be learned every text has 0. Repeated rows each get their own result; other columns are not read.
    """
    texts = documents.select("doc_id", "text")
    if classifier is None:
        return texts.select("doc_id", F.lit(0.0).alias("score"))

    def predict(batches):
        weights, known = classifier.weights, {}
        for part in batches:
            out = []
            for t in part["text"]:
                hits = set()
                for w in set(_WORD.findall(t.lower())) if t else ():
                    own = known.get(w)
                    if own is None:
                        if len(known) > KEPT_WORDS:
                            known.clear()
                        own = known[w] = tuple(e for e in entries_of(w) if e in weights)
                    if own:
                        hits.update(own)
                out.append(classifier.bias + sum(weights[e] for e in sorted(hits)))
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": 1 / (1 + np.exp(-np.clip(np.array(out, float), -60, 60)))})

    return texts.mapInPandas(predict, "doc_id long, score double")
