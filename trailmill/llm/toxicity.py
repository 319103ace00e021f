"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models on the words of a
text; each model also sees the probabilities of the categories before it. In
training, those probabilities are out of fold: every labelled text gets them
from models that have not seen it, so later models learn how far the earlier
ones can be trusted on new texts.

The labels give one category, ``toxic``. Two finer ones come before it in the
chain and are set for toxic texts that hold one of their ``MARKERS``; the last
model decides with words of any language.

A text's features are which of ``BUCKETS`` hashed words and word beginnings (of
``BEGINNINGS`` bytes, for languages that inflect or compound) it holds, weighted
by their log-ratio between the classes (rare ones weigh 0). Whole texts are read.
Training takes at most ``SAMPLE`` labelled documents of either label, those with
the smallest hashes of their ids; that is the only bound. A document with several
labels is toxic if one says so. Without labelled texts of both kinds every
probability is the share of toxic ones (0 without any).

Null and empty texts have no words and get the model's base rate. Repeated rows
repeat. Rows without doc_id are scored and never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm import kernels
from trailmill.llm.common import read

#: Words that mark the finer categories.
MARKERS = {
    "insult": ("clown", "idiot", "loser", "moron", "scum"),
    "contempt": ("disgusting", "pathetic", "stupid", "trash", "worthless"),
}
CATEGORIES = (*MARKERS, "toxic")
BUCKETS = 1 << 20
BEGINNINGS = (4, 6)
SAMPLE, FOLDS, STEPS = 2500, 3, 80
#: A feature must stand in so many texts, and in this share of the smaller class.
RARE, RARE_SHARE = 4, 0.01
#: Weight of the squared parameters in the loss, and the size of the first steps.
RIDGE, RATE = 1e-4, 0.3
#: Log-ratio from which a word counts.
TELLING = 2.0
CUT = 0.5


def buckets(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of the texts: index of the first, features as buckets, their texts."""
    for part in kernels.words([t and t.lower() for t in texts], kernels.PLAIN, BEGINNINGS):
        owner = np.repeat(np.arange(len(part.counts)), part.counts)
        found, whose = [part.hashes], [owner]
        for begun in part.prefixes.values():
            found.append(begun[begun != 0])
            whose.append(owner[begun != 0])
        owner = np.concatenate(whose)
        order = np.argsort(owner, kind="stable")
        hashes = np.concatenate(found)[order]
        yield part.first, (hashes % np.uint64(BUCKETS)).astype(np.int64), owner[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Sparse 0/1 rows: the buckets of each text, one text after another."""

    def __init__(self, index: np.ndarray, owner: np.ndarray, count: int, width: int = BUCKETS):
        self.index, self.owner, self.count, self.width = index, owner, count, width

    @staticmethod
    def of(found: list[np.ndarray]) -> Rows:
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        return Rows(np.concatenate([np.zeros(0, np.int64), *found]), owner, len(found))

    def only(self, used: np.ndarray) -> Rows:
        """The same rows over some of the buckets, numbered anew."""
        place = np.full(self.width, -1)
        place[used] = np.arange(len(used))
        kept = place[self.index] >= 0
        return Rows(place[self.index[kept]], self.owner[kept], self.count, len(used))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.index], self.count)

    def per_bucket(self, of_rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, of_rows[self.owner], self.width)


class Linear:
    """Logistic regression on words and on earlier probabilities."""

    def __init__(self, rows: Rows, earlier: np.ndarray, label: np.ndarray):
        positive, negative = rows.per_bucket(label), rows.per_bucket(1.0 - label)
        n = label.sum()
        ratio = np.log((positive + 0.5) / (n + 1)) - np.log((negative + 0.5) / (len(label) - n + 1))
        fewer = min(n, len(label) - n)
        ratio[positive + negative < max(RARE, RARE_SHARE * fewer)] = 0
        # Words that tell nothing apart by themselves are noise in a long text.
        ratio[np.abs(ratio) < TELLING] = 0
        share = (n + 0.5) / (len(label) + 1)
        self.base = np.log(share / (1 - share))
        self.chain, self.weights = np.zeros(earlier.shape[1]), np.zeros(0)
        self.used = np.flatnonzero(ratio) if 0 < n < len(label) else np.zeros(0, np.int64)
        if not len(self.used):
            return
        some, ratio = rows.only(self.used), ratio[self.used]
        words = np.zeros(len(self.used))
        square = [np.zeros(len(words)), np.zeros(earlier.shape[1]), 0.0]
        for _ in range(STEPS):
            p = _sigmoid(some.times(words * ratio) + earlier @ self.chain + self.base)
            miss = (p - label) / len(label)
            slopes = [
                some.per_bucket(miss) * ratio + RIDGE * words,
                earlier.T @ miss + RIDGE * self.chain,
                miss.sum(),
            ]
            square = [s + g * g for s, g in zip(square, slopes, strict=True)]
            moves = [RATE * g / (np.sqrt(s) + 1e-12) for s, g in zip(square, slopes, strict=True)]
            words, self.chain, self.base = words - moves[0], self.chain - moves[1], self.base - moves[2]
        self.weights = words * ratio

    def predict(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        words = np.zeros(rows.width)
        words[self.used] = self.weights
        return _sigmoid(rows.times(words) + earlier @ self.chain + self.base)


class Chain:
    def __init__(self, found: list[np.ndarray], labels: np.ndarray):
        """``labels`` has one column per category, in the order of the chain."""
        folds = np.arange(len(found)) % FOLDS
        everything, models = Rows.of(found), []
        earlier = np.zeros((len(found), 0))
        for k in range(labels.shape[1]):
            label = labels[:, k].astype(float)
            models.append(Linear(everything, earlier, label))
            column = np.zeros(len(found))
            for f in range(FOLDS):
                out = folds == f
                if out.any() and not out.all():
                    seen = Linear(
                        Rows.of([x for x, o in zip(found, out, strict=True) if not o]), earlier[~out], label[~out]
                    )
                    held = Rows.of([x for x, o in zip(found, out, strict=True) if o])
                    column[out] = seen.predict(held, earlier[out])
            earlier = np.column_stack([earlier, column])
        self.used = np.unique(np.concatenate([m.used for m in models]))
        self.words = np.zeros((len(models), len(self.used)))
        for row, m in zip(self.words, models, strict=True):
            row[np.searchsorted(self.used, m.used)] = m.weights
        self.chains = [m.chain for m in models]
        self.bases = [float(m.base) for m in models]

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """A row per text, a column per category."""
        place = np.full(BUCKETS, -1)
        place[self.used] = np.arange(len(self.used))
        totals = np.zeros((len(texts), len(self.bases)))
        for first, found, owner in buckets(texts):
            at = place[found]
            kept = at >= 0
            held = np.unique(owner[kept] * BUCKETS + at[kept])  # each word once a text
            who, which = first + held // BUCKETS, held % BUCKETS
            for k in range(len(self.bases)):
                totals[:, k] += np.bincount(who, self.words[k][which], len(texts))
        out = np.zeros_like(totals)
        for k, (chain, base) in enumerate(zip(self.chains, self.bases, strict=True)):
            out[:, k] = _sigmoid(totals[:, k] + out[:, :k] @ chain + base)
        return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """A chain from ``doc_id, text`` and ``doc_id, toxic`` rows."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic") > 0).alias("toxic"))
        .selectExpr("*", "row_number() OVER (PARTITION BY toxic ORDER BY xxhash64(doc_id), doc_id) AS k")
        .where(f"k <= {sample}")
        .select("doc_id", "toxic")
    )

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            rows = [b""] * len(texts)
            for first, found, owner in buckets(texts):
                ends = np.searchsorted(owner, np.arange(1, len(texts) - first + 1))
                for k, x in enumerate(np.split(found, ends[:-1])):
                    rows[first + k] = rows[first + k] or np.unique(x).astype(np.int32).tobytes()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "found": rows})

    # At most twice the sample: small enough to send to all tasks, and to collect.
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = labelled.mapInPandas(features, "doc_id bigint, toxic boolean, found binary").collect()
    unique = {bytes(r["found"]): r for r in sorted(rows, key=lambda r: (r["doc_id"], r["found"]))}
    examples = sorted(unique.values(), key=lambda r: (r["doc_id"], r["found"]))
    found = [np.frombuffer(r["found"], np.int32).astype(np.int64) for r in examples]
    toxic = np.array([r["toxic"] for r in examples], bool)
    columns = []
    for words in MARKERS.values():
        marks = next(kernels.words([" ".join(words)], kernels.PLAIN)).hashes % np.uint64(BUCKETS)
        columns.append(toxic & np.array([bool(np.isin(marks, x).any()) for x in found], bool))
    return Chain(found, np.column_stack([*columns, toxic]))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with a probability per category behind the other columns."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(chain.predict(batch.tolist()), columns=list(CATEGORIES))

    judge = F.pandas_udf(run, ", ".join(f"{c} double" for c in CATEGORIES))
    return docs.withColumn("_judged", judge(F.col("text"))).select(
        *[F.col(f"`{c}`") for c in docs.columns], "_judged.*"
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents judged toxic, with all probabilities."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, chain).where(f"toxic >= {CUT}").drop("text")
