"""URL filter: allow and block rules, and a learned verdict where no rule fits.

A rule like ``example.com/en/`` names a host and the start of a path. It fits
that host and its subdomains; of several fitting rules the longest decides.

Other addresses are judged by logistic regression on hashed character n-grams
of host and path. It is trained on a small labelled table of addresses: those
whose rule is known, at most ``sample`` of them, the ones with the smallest
hashes. Only the training looks at a sample; every address is judged. Fitted
weights are one array of ``buckets`` numbers, so scoring is arithmetic on
arrays inside the row and needs no join.

Null addresses and those without ``://`` have empty host and path, fit no rule
and get the learned verdict of an empty text (the intercept alone). Repeated
rows repeat. Without labelled addresses, or with only one kind of label, the
learned probability is the share of blocked ones (one half if there are none).
"""

from __future__ import annotations

from math import log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.common import LOWER, UPPER, landed, read

#: Rule and verdict.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
GRAM = 4
BUCKETS = 2048
#: The most labelled addresses that the model is fitted on.
SAMPLE = 4000
STEPS = 30

_AFTER = "substr(url, nullif(instr(url, '://'), 0) + 3)"
HOST = f"coalesce(translate(regexp_substr({_AFTER}, '^[^/?#]+'), '{UPPER}', '{LOWER}'), '')"
PATH = f"coalesce(regexp_extract({_AFTER}, '^[^/?#]*([^?#]*)', 1), '')"


def split_url(pages: DataFrame) -> DataFrame:
    return pages.selectExpr("*", f"{HOST} AS host", f"{PATH} AS path")


def apply_rules(split: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Adds ``rule`` and ``ruled``, its verdict; null where none fits.

    The rules are tried from the longest to the shortest.
    """
    rule = verdict = "CASE"
    for r in sorted(rules, key=lambda r: (-len(r), r)):
        host, path = r.partition("/")[0], r[len(r.partition("/")[0]) :]
        fits = f"(host = '{host}' OR endswith(host, '.{host}')) AND startswith(path, '{path}')"
        rule += f" WHEN {fits} THEN '{r}'"
        verdict += f" WHEN {fits} THEN '{rules[r]}'"
    return split.selectExpr("*", f"{rule} END AS rule", f"{verdict} END AS ruled")


def grams(n: int = GRAM, buckets: int = BUCKETS) -> str:
    """SQL text: the hash buckets of the distinct n-grams of host and path."""
    text = "concat('^', host, ' ', path, '$')"
    count = f"char_length({text}) - {n - 1}"
    gram = f"cast(pmod(xxhash64(substr({text}, i, {n})), {buckets}) as int)"
    return f"array_distinct(transform(sequence(1, greatest(1, {count})), i -> {gram}))"


def fit(
    labelled: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE
) -> tuple[float, list[float]]:
    """Intercept and weights, from ``host, path, ruled`` rows."""
    # Rows with equal host and path are one example.
    chosen = (
        labelled.groupBy("host", "path")
        .agg(F.min("ruled").alias("ruled"))
        .orderBy(F.xxhash64("host", "path"), "host", "path")
        .limit(sample)
    )
    # Bounded by the sample: one partition in a fixed order, so reruns agree.
    rows = (
        landed(
            chosen.selectExpr(
                "host",
                "path",
                "if(ruled = 'block', 1D, 0D) AS label",
                f"transform({grams(buckets=buckets)}, k -> cast(k as string)) AS found",
            ),
            "labelled-urls",
        )
        .coalesce(1)
        .sortWithinPartitions("host", "path")
    )
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    n, blocked = seen["n"], seen["blocked"] or 0.0
    if not 0 < blocked < n:
        share = (blocked + 0.5) / (n + 1.0)
        return log(share / (1 - share)), [0.0] * buckets
    # Sparse 0/1 vectors: place k is bucket k.
    places = CountVectorizerModel.from_vocabulary(
        [str(k) for k in range(buckets)], inputCol="found", outputCol="features"
    )
    model = LogisticRegression(maxIter=STEPS, regParam=1e-3, standardization=False).fit(
        places.transform(rows).select("label", "features")
    )
    return float(model.intercept), [float(x) for x in model.coefficients.toArray()]


def judge(
    pages: DataFrame,
    rules: dict[str, str] = RULES,
    model: tuple[float, list[float]] | None = None,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the learned ``score``."""
    ruled = apply_rules(split_url(pages), rules)
    model = model or fit(ruled.where("ruled IS NOT NULL").select("host", "path", "ruled"))
    intercept, weights = model
    table = F.lit(weights)
    total = F.aggregate(
        F.expr(grams(buckets=len(weights))), F.lit(intercept), lambda s, k: s + F.get(table, k)
    )
    return ruled.withColumn("score", 1 / (1 + F.exp(-total))).selectExpr(
        "* EXCEPT (ruled)", "coalesce(ruled, if(score >= 0.5D, 'block', 'allow')) AS verdict"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "score"
    )
