"""Quality rules: base text statistics and a hashed n-gram likelihood ratio.

Base statistics of a text, over its words (runs of characters that are no ASCII
white space):

- ``word_chars``: code points in words;
- ``n_symbols``: characters of ``#*$%&|<>`` in the text;
- ``n_dup_lines``: ``\\n``-separated lines holding a word that equal, character
  for character, an earlier line of the same text;
- ``n_repeat_words``: word places covered by an 8-word window whose words stand
  at least twice in the text (overlapping places count, the first one too).

``base_failed`` holds for fewer than ``MIN_WORDS`` words or more than
``MAX_REPEAT`` of the words in repeated windows.

The method's verdict compares two multinomials over ``BUCKETS`` hashed word
n-grams (lower-cased words and pairs of neighbouring words): the trusted target,
counted over every document that ``labels`` marks ``quality = 1``, and the raw
corpus, counted over every document. Both are summed map-side per bucket, so the
model has ``BUCKETS`` rows whatever the corpus size, and it is broadcast with that
bound. Both passes run in Arrow batches inside the tasks (regular expressions,
xxhash and numpy per document); Spark partitions the texts and sums the
per-partition counters by bucket. A document's score is the mean log-likelihood ratio
``ln p_target(g) - ln p_raw(g)`` over its n-grams, each document's own n-grams
left out of both counts, add-``ALPHA`` smoothed (the target's prior scaled to its
size, so an n-gram seen nowhere else weighs 0). Sparse n-grams pull every score
down alike, so the threshold is set by the trusted documents themselves: their
mean score less ``SPREAD`` standard deviations, from exact sums over all of them.
A document is kept when its score reaches that threshold and the base rules
pass. Scores are summed as integer millionths, so runs agree.

Defined cases: a null text has no words, lines or n-grams (score 0, base
failed); an empty table gives an empty result; repeated rows give repeated
result rows with equal values; labels with null or repeated doc_ids count once
per document id, and without trusted documents the target is uniform. Columns
besides ``doc_id`` and ``text`` are not read, so no name can clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xxhash import xxh64_intdigest

from trailmill.llm.common import SPACED_WORD, landed, read

MIN_WORDS = 20
#: Percent of the words that may stand in repeated 8-word windows.
MAX_REPEAT = 30
WINDOW = 8
#: Hashed n-gram buckets: the model's size, independent of the corpus.
BUCKETS = 1 << 18
ALPHA = 0.5
#: Kept: a score at least the trusted documents' mean less SPREAD of their standard deviations.
SPREAD = 2.0
SYMBOLS = "[#*$%&|<>]"

_WORDS = f"regexp_extract_all(coalesce(text, ''), r'{SPACED_WORD}', 0)"
#: (item, id) rows of trusted documents broadcast at most; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 5_000_000


def _repeat_words(words: str, n: str) -> str:
    """SQL text: places of ``words`` covered by a window that stands twice or more.

    Windows are compared by a 64-bit hash of their words: two different windows
    of one text agree with a chance of about n^2 / 2^64.
    """
    wins = (
        f"sort_array(transform(sequence(0, {n} - {WINDOW}), "
        f"i -> named_struct('w', xxhash64(slice({words}, i + 1, {WINDOW})), 'i', i)))"
    )
    same = "(k > 1 AND s[k - 1].w = s[k - 2].w) OR (k < size(s) AND s[k - 1].w = s[k].w)"
    starts = f"transform(filter(sequence(1, size(s)), k -> {same}), k -> s[k - 1].i)"
    covered = f"size(array_distinct(flatten(transform({starts}, i -> sequence(i, i + {WINDOW - 1})))))"
    return f"if({n} >= {WINDOW}, CAST(transform(array({wins}), s -> {covered})[0] AS BIGINT), 0L)"


def _stats(words: str, lines: str) -> dict[str, str]:
    return {
        "n_words": f"CAST(size({words}) AS BIGINT)",
        "word_chars": f"aggregate({words}, 0L, (acc, x) -> acc + length(x))",
        "n_symbols": f"CAST(coalesce(length(text) - length(regexp_replace(text, '{SYMBOLS}', '')), 0) AS BIGINT)",
        "n_dup_lines": f"CAST(size({lines}) - size(array_distinct({lines})) AS BIGINT)",
        "n_repeat_words": _repeat_words(words, f"size({words})"),
    }


_LINES = r"filter(split(coalesce(text, ''), '\n', -1), l -> l rlike r'[^\x20\x09-\x0D]')"
STATS = list(_stats("tw", "tl"))


def _measured(docs: DataFrame, grams: bool) -> DataFrame:
    """``docs`` with the base statistics (and, if ``grams``, ``_x``: the n-gram
    count and bucket runs) as columns.

    Words and lines are bound to lambda variables, so each is extracted once per
    row: a plain column would be inlined into every use, lambdas included.
    """
    fields = ", ".join(f"{v} AS {k}" for k, v in _stats("tw", "tl").items())
    if grams:
        fields += f", {_runs(_hashed('tw'))} AS _x"
    bound = f"transform(array({_WORDS}), tw -> transform(array({_LINES}), tl -> struct({fields}))[0])[0]"
    return docs.withColumn("_m", F.expr(bound)).selectExpr("*", "_m.*").drop("_m")


def base_rules(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, computed from its ``text``."""
    return _failed(_measured(docs, False))


def _failed(frame: DataFrame) -> DataFrame:
    return frame.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT),
    )


def _hashed(words: str) -> str:
    """SQL text: the bucket of every lower-cased word and of every pair of neighbours."""
    low = f"transform({words}, w -> lower(w))"
    one = "transform(ws, w -> CAST(pmod(xxhash64(w), {b}) AS INT))".format(b=BUCKETS)
    two = "transform(sequence(1, size(ws) - 1), i -> CAST(pmod(xxhash64(ws[i - 1], ws[i]), {b}) AS INT))".format(
        b=BUCKETS
    )
    return f"transform(array({low}), ws -> if(size(ws) > 1, concat({one}, {two}), {one}))[0]"


def _runs(hashed: str) -> str:
    """SQL text: n and the distinct buckets ``bc`` (b, c) of a bucket array, by sorting."""
    starts = "if(size(h) = 0, array(), filter(sequence(1, size(h)), i -> i = 1 OR h[i - 1] <> h[i - 2]))"
    runs = (
        "transform(st, (i, k) -> named_struct('b', h[i - 1], 'c', "
        "CAST(if(k + 1 < size(st), st[k + 1], size(h) + 1) - i AS BIGINT)))"
    )
    return f"transform(array(sort_array({hashed})), h -> struct(size(h) AS n, transform(array({starts}), st -> {runs})[0] AS bc))[0]"


WORD = re.compile(SPACED_WORD)
SYMBOL = re.compile(SYMBOLS)


def _grams(words: list[str]) -> np.ndarray:
    """Buckets of the lower-cased words and of each pair of neighbours."""
    low = [w.lower().encode("utf-8", "surrogatepass") for w in words]
    seen = [xxh64_intdigest(w) for w in low]
    seen += [xxh64_intdigest(a + b" " + b) for a, b in zip(low, low[1:])]
    return np.fromiter((x % BUCKETS for x in seen), dtype=np.int64, count=len(seen))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Raw and target bucket counts of one partition, as (b, raw, target) rows."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        every, trusted = [], []
        for text, known in zip(batch["text"], batch["trusted"], strict=True):
            grams = _grams(WORD.findall(text or ""))
            every.append(grams)
            if known:
                trusted.append(grams)
        if every:
            raw += np.bincount(np.concatenate(every), minlength=BUCKETS)
        if trusted:
            target += np.bincount(np.concatenate(trusted), minlength=BUCKETS)
    held = np.nonzero(raw)[0]
    yield pd.DataFrame({"b": held.astype(np.int32), "raw": raw[held], "target": target[held]})


def _repeated(words: list[str]) -> int:
    """Word places covered by an 8-word window that stands twice or more."""
    if len(words) < WINDOW:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    counts = Counter(windows)
    marks = np.zeros(len(words) + 1, np.int64)
    for i, window in enumerate(windows):
        if counts[window] > 1:
            marks[i] += 1
            marks[i + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(marks)[: len(words)]))


def _scorer(sent):
    """The scoring pass over one partition, with the model as numpy arrays."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target, raw_total, target_total = sent.value
        for batch in batches:
            out = []
            for row, doc_id, text, known in zip(batch["_row"], batch["doc_id"], batch["text"], batch["trusted"], strict=True):
                text = text or ""
                words = WORD.findall(text)
                lines = [x for x in text.split("\n") if WORD.search(x)]
                grams = _grams(words)
                n, micro = len(grams), 0
                if n:
                    b, c = np.unique(grams, return_counts=True)
                    own, own_n = (c, n) if known else (0, 0)
                    r_total, t_total = raw_total - n, target_total - own_n
                    a_t = ALPHA * t_total / max(r_total, 1)
                    bottom = t_total + a_t * BUCKETS
                    p_t = (target[b] - own + a_t) / bottom if bottom else np.full(len(b), 1 / BUCKETS)
                    p_r = (raw[b] - c + ALPHA) / (r_total + ALPHA * BUCKETS)
                    parts = np.floor(1e6 * c * (np.log(p_t + 1e-300) - np.log(p_r)) + 0.5).astype(np.int64)
                    micro = int(int(parts.sum()) / n)
                out.append((
                    row, doc_id, bool(known), len(words), sum(map(len, words)), len(SYMBOL.findall(text)),
                    len(lines) - len(set(lines)), _repeated(words), micro,
                ))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCORED.split(", ")])

    return score


SCORED = (
    "_row long, doc_id long, trusted boolean, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, micro long"
)


def rules(docs: DataFrame, labels: DataFrame, spread: float = SPREAD) -> DataFrame:
    """Base statistics, score and verdict of every row of ``docs`` (doc_id, text).

    Two passes over the texts, in Arrow batches: one counts the hashed n-grams
    of each partition into ``BUCKETS`` counters, summed by bucket; the other
    scores each document against the model (``BUCKETS`` rows, broadcast as
    arrays) and computes the base statistics. Texts are never shuffled while the
    trusted ids can be broadcast. Each row is scored as it stands, so repeated
    or null doc_ids keep their own result.
    """
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    flags = trusted.withColumn("trusted", F.lit(True))
    if trusted.count() <= BROADCAST_IDS:
        flags = F.broadcast(flags)
    keyed = (
        docs.select("doc_id", "text")
        .withColumn("_row", F.monotonically_increasing_id())
        .join(flags, "doc_id", "left")
        .withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    )
    counts = (
        keyed.select("text", "trusted")
        .mapInPandas(_count, "b int, raw long, target long")
        .groupBy("b")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )
    # BUCKETS bounds the model's rows, whatever the corpus size.
    model_rows = counts.collect()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in model_rows:
        raw[r.b], target[r.b] = r.raw, r.target
    sent = docs.sparkSession.sparkContext.broadcast((raw, target, int(raw.sum()), int(target.sum())))
    scored = landed(
        keyed.select("_row", "doc_id", "text", "trusted").mapInPandas(_scorer(sent), SCORED), "quality-scores"
    )
    bar = (
        scored.where("trusted")
        .selectExpr("CAST(micro AS DECIMAL(38, 0)) AS s")
        .agg(F.expr("nullif(count(*), 0)").alias("k"), F.sum("s").alias("s1"), F.expr("sum(s * s)").alias("s2"))
        .selectExpr(
            f"coalesce((s1 / k - {spread} * sqrt(greatest(CAST(s2 / k - (s1 / k) * (s1 / k) AS DOUBLE), 0))) / 1e6,"
            " -1e300) AS threshold"
        )
    )
    return (
        _failed(scored)
        .withColumn("score", F.col("micro") / 1e6)
        .crossJoin(bar)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("threshold")))
        .drop("micro", "trusted", "_row")
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
