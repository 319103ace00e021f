"""Language ID by compression with per-language dictionaries.

For every language a raw-content zstandard dictionary is made of the words and
word pairs that most labelled documents of it hold, the most frequent last,
where matches are cheapest. A text is encoded with each dictionary, in blocks
of ``BLOCK`` bytes so that a long text is compared with the dictionaries and
not with its own beginning; the language whose blocks come out smallest in sum
is chosen. Texts under ``SHORT`` bytes would often be stored as they are, so
they are encoded behind the end of the dictionary, less the size of that end
alone. Letters are lowered. Whole texts are read.

A text is rejected when the choice is not clear: when the winner is within
``MARGIN`` of the runner-up's size. ``score`` is that relative distance, scaled
to 1 at ``SURE`` and above.

Training reads text and lang of the documents it is given: ``SAMPLE`` different
texts per language, those with the smallest hashes, in slices of ``SLICE``
characters; dictionaries hold at most ``DICTIONARY`` bytes, of at most
``LANGUAGES`` languages. These are the only bounds, and they bound the model,
not the texts it is used on.

A text that is null or has no letter is ``und`` with score 0 and rejected; so
is every text if nothing was learned. With one language only, texts are that
language with score 1. Ties go to the first language in code point order.
Repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.common import read

DICTIONARY, SLICE, SAMPLE, LANGUAGES = 16 << 10, 2048, 400, 64
BLOCK, SHORT, END = 4096, 200, 512
MARGIN, SURE = 0.002, 0.1
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def _encoded(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def dictionary(slices: list[str], size: int = DICTIONARY) -> bytes:
    """Words and word pairs of at least two texts; those that cover most come last."""
    counts: Counter[str] = Counter()
    for text in slices:
        words = text.lower().split()
        counts.update({*words, *map(" ".join, zip(words, words[1:]))})
    kept, held = [], 0
    for term, n in sorted(counts.items(), key=lambda x: (-x[1] * len(x[0]), x[0])):
        held += len(_encoded(term)) + 1
        if n < 2 or held > size:
            break
        kept.append(term)
    return _encoded(" ".join(reversed(kept)) + " ") if kept else b""


def train(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content per language, from ``text, lang`` rows."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").selectExpr(
        "lang", "xxhash64(text) AS h", "text"
    )
    chosen = (
        rows.select("lang", "h")
        .distinct()
        # A language may hold most texts: first its smallest hashes of each of
        # 64 parts, then the smallest of those.
        .selectExpr("*", "row_number() OVER (PARTITION BY lang, pmod(h, 64) ORDER BY h) AS k")
        .where(f"k <= {SAMPLE}")
        .selectExpr("lang", "h", "row_number() OVER (PARTITION BY lang ORDER BY h) AS k")
        .where(f"k <= {SAMPLE}")
    )
    languages = [r["lang"] for r in chosen.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # At most SAMPLE rows of each of at most LANGUAGES languages.
    slices = rows.join(F.broadcast(chosen.drop("k")), ["lang", "h"]).groupBy("lang", "h").agg(
        F.min(F.substring("text", 1, SLICE)).alias("slice")
    )
    content: dict[str, list[str]] = {lang: [] for lang in sorted(languages)}
    for row in slices.collect():
        content[row["lang"]].append(row["slice"])
    return {lang: dictionary(parts) for lang, parts in content.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.encoders, self.ends = [], []
        settings = zstandard.ZstdCompressionParameters.from_level(
            3,
            min_match=3,
            strategy=zstandard.STRATEGY_BTOPT,
            write_checksum=False,
            write_content_size=False,
        )
        for content in dictionaries.values():
            content = content or b"........"
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(compression_params=settings)
            encoder = zstandard.ZstdCompressor(dict_data=kept, compression_params=settings)
            self.encoders.append(encoder)
            end = content[-END:]
            self.ends.append((end, len(encoder.compress(end))))

    def sizes(self, data: bytes) -> list[int]:
        if len(data) < SHORT:
            return [
                len(e.compress(end + data)) - alone
                for e, (end, alone) in zip(self.encoders, self.ends, strict=True)
            ]
        blocks = [data[a : a + BLOCK] for a in range(0, len(data), BLOCK)]
        return [sum(len(e.compress(b)) for b in blocks) for e in self.encoders]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        if text is None or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        sizes = self.sizes(_encoded(text))
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        second = min(s for k, s in enumerate(sizes) if k != best)
        margin = (second - sizes[best]) / max(1, second)
        return self.languages[best], min(1.0, max(0.0, margin / SURE)), margin < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected`` behind the other columns."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            yield pd.DataFrame(
                [classifier.judge(t) for t in batch], columns=["lang_pred", "score", "rejected"]
            )

    judge = F.pandas_udf(run, "lang_pred string, score double, rejected boolean")
    return docs.withColumn("_judged", judge(F.col(text).cast("string"))).select(
        *[F.col(f"`{c}`") for c in docs.columns], "_judged.*"
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = "coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)"
    dictionaries = train(docs.where(f"NOT {held_out}"))
    return identify(docs.selectExpr("doc_id", "text", f"{held_out} AS held_out"), dictionaries).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )
