"""Secret scan: known shapes, and a battery of randomness tests.

*Known shapes* are three patterns (assignments, access keys, long hexadecimal
runs). They are always reported.

*The battery* looks at every run of letters, digits and ``+/_-`` of at least
``SHORTEST`` characters that holds a letter and a digit; ``=`` belongs to a run
only as its padding, so a name and its value are two runs. The encoding is
inferred as the smallest alphabet that holds all characters. A run that no
alphabet holds (words with ``-`` or ``_`` joined to others by ``/`` or ``+``) is
split at the characters that do not fit: at ``+/``, at ``_-`` and at all four,
and each part that is long enough is looked at instead. Of parts that are
reported, those inside another are left out. Three tests
ask whether a run could be uniformly random over its alphabet:

* chi-squared: do all characters come equally often;
* runs: do characters of the lower and the upper half of the alphabet change
  as often as chance would have it (Wald-Wolfowitz);
* serial correlation: is a character's place in the alphabet independent of the
  one before.

Each p-value is two-sided or upper-tailed as its test asks, and three times the
smallest is the run's p-value of being random. Runs that are not random
(identifiers, words with numbers, counters) are rejected under control of the
false discovery rate: by Benjamini and Hochberg, separately for each
class of encoding and length, since a short run can hardly be told from a
random one. At most about ``RATE`` of the runs set aside in a class are random
ones. What is not set aside, and long enough that the tests would have set
ordinary text aside (``ENOUGH``), is reported as ``random``.

The ranks of the procedure come from counts of all runs of the corpus per class
and p-value; p-values are held on a fixed grid of ``GRID`` steps, rounded up,
so the counts are a small table whatever the corpus.

Null and empty texts have no spans. Repeated rows repeat, and their runs count
each. Spans are code points, the end exclusive. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.common import landed, read

# Kinds in their order, and their patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs of 24 and more
KINDS = ("assign", "access", "hex", "random")

SHORTEST = 16
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?")
#: Parts of a run that no alphabet holds.
PARTS = tuple(re.compile(p) for p in (r"[A-Za-z0-9_-]{16,}=*", r"[A-Za-z0-9+/]{16,}=*", r"[A-Za-z0-9]{16,}=*"))
DIGIT, ALPHA = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Alphabets in the order they are tried, and the length from which ordinary
#: text over them would be set aside.
ALPHABETS = {
    "hex": ("0123456789abcdef", 24),
    "HEX": ("0123456789ABCDEF", 24),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24),
    "lower36": ("0123456789abcdefghijklmnopqrstuvwxyz", 24),
    "upper36": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 24),
    "base62": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
    "base64url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 20),
}
RATE, GRID = 0.05, 200
#: Lengths are told apart up to these.
LENGTHS = (16, 20, 24, 32, 40, 64, 128, 256)


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _upper_chi(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees, by Wilson and Hilferty."""
    return _upper_normal(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def uniformity(codes: np.ndarray, size: int) -> float:
    expected = len(codes) / size
    counts = np.bincount(codes, minlength=size)
    return _upper_chi(float(((counts - expected) ** 2).sum() / expected), size - 1)


def runs(codes: np.ndarray, size: int) -> float:
    high = codes >= size // 2
    a, b = int(high.sum()), int((~high).sum())
    if not a or not b:
        # All in one half: each further character had one chance in two.
        return min(1.0, 2.0 ** (1 - len(codes)))
    n = a + b
    mean = 2 * a * b / n + 1
    variance = (mean - 1) * (mean - 2) / max(1, n - 1)
    if variance <= 0:
        return 1.0
    return 2 * _upper_normal(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(variance))


def serial(codes: np.ndarray, size: int) -> float:
    x = codes - codes.mean()
    total = float((x * x).sum())
    if total == 0:
        return 0.0
    r = float((x[1:] * x[:-1]).sum()) / total
    n = len(codes)
    return 2 * _upper_normal(abs(r + 1 / n) * math.sqrt(n))


_CODES = {
    name: {c: k for k, c in enumerate(letters)} for name, (letters, _) in ALPHABETS.items()
}


def encoding(run: str) -> str | None:
    """The smallest alphabet that holds the run, without padding."""
    seen = set(run.rstrip("="))
    return next((name for name, codes in _CODES.items() if seen <= codes.keys()), None)


def p_random(run: str, name: str) -> float:
    codes = np.array([_CODES[name][c] for c in run.rstrip("=")])
    size = len(_CODES[name])
    return min(1.0, 3 * min(t(codes, size) for t in (uniformity, runs, serial)))


def cell(p: float) -> int:
    """Grid step of a p-value on a logarithmic scale; larger p, smaller step."""
    return min(GRID - 1, int(-math.log10(max(p, 1e-300)) * 20))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def candidates(text: str) -> list[tuple[int, int, str, int]]:
    """``start, end, class, cell`` of the runs that are tested."""
    found = []
    for m in RUN.finditer(text):
        spans = [m.span()]
        if encoding(m[0]) is None:
            spans = sorted({x.span() for part in PARTS for x in part.finditer(text, *m.span())})
        for start, end in spans:
            run = text[start:end]
            if not DIGIT.search(run) or not ALPHA.search(run):
                continue
            size = len(run.rstrip("="))
            band = max(b for b in LENGTHS if b <= size)
            name = encoding(run)
            found.append((start, end, f"{name}/{band}", cell(p_random(run, name))))
    return found


SCANNED = (
    "base array<struct<kind:string,start:int,end:int>>, "
    "tested array<struct<start:int,end:int,class:string,cell:int>>"
)


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = ["" if t is None else t for t in batch]
        rows = [
            (
                [dict(zip(("kind", "start", "end"), x, strict=True)) for x in base_spans(t)],
                [dict(zip(("start", "end", "class", "cell"), x, strict=True)) for x in candidates(t)],
            )
            for t in texts
        ]
        yield pd.DataFrame(rows, columns=["base", "tested"])


def set_aside(counts: dict[str, dict[int, int]], rate: float = RATE) -> dict[str, int]:
    """For each class, the smallest cell (largest p) that is rejected.

    Benjamini and Hochberg: the largest p of which at least ``p * m / rate``
    runs are as small.
    """
    found = {}
    for name, cells in counts.items():
        total, below = sum(cells.values()), 0
        for c in sorted(cells, reverse=True):
            below += cells[c]
            if 10 ** (-c / 20) * total <= rate * below:  # the upper edge of the cell
                found[name] = c
    return found


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) without the text, with ``spans``: kind, start
    and end of each, by start and then by kind."""
    judged = F.pandas_udf(_scan, SCANNED)(F.col("text"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    scanned = landed(
        docs.withColumn("_found", judged).select(*others, "_found.base", "_found.tested"), "secret-scan"
    )
    counts: dict[str, dict[int, int]] = {}
    # At most one row per class and grid step.
    tested = scanned.select(F.explode("tested").alias("t")).select("t.class", "t.cell")
    for row in tested.groupBy("class", "cell").count().collect():
        counts.setdefault(row["class"], {})[row["cell"]] = row["count"]
    limits = set_aside(counts)
    open_classes = [
        (name, limits.get(name, GRID))
        for name in counts
        if int(name.split("/")[1]) >= ALPHABETS[name.split("/")[0]][1]
    ]
    limit = "map(" + ", ".join(f"'{n}', {c}" for n, c in open_classes) + ")"
    kept = f"filter(tested, t -> t.cell < {limit}[t.class])" if open_classes else "slice(tested, 1, 0)"
    order = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    within = "o.start <= t.start AND t.end <= o.end AND o.end - o.start > t.end - t.start"
    widest = f"filter(kept, t -> NOT exists(kept, o -> {within}))"
    spans = f"concat(base, transform({widest}, t -> struct('random' AS kind, t.start, t.end)))"
    ordered = f"array_sort(transform({spans}, x -> struct(x.start AS start, {order} AS rank, x.end AS end, x.kind AS kind)))"
    names = [f"`{c}`" for c in docs.columns if c != "text"]
    return scanned.selectExpr(*names, "base", f"{kept} AS kept").selectExpr(*names, f"{ordered} AS spans")


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = [
        f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint) AS n_{k}" for k in KINDS[:3]
    ]
    base = "filter(spans, x -> x.kind <> 'random')"
    return scan(docs).selectExpr(
        "doc_id",
        *counts,
        f"sha2({_joined(base)}, 256) AS base_sha256",
        f"{_joined('spans')} AS spans",
    )
