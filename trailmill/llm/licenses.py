"""License scan: which text blocks hold a license notice.

Two kinds of evidence. *Phrases* are words that stand consecutively. *Templates*
are longer notices; a block (one line) matches when it holds at least
``threshold`` of the template's distinct words, in any order, so reworded or
reflowed notices are found.

The template side is an exact set-similarity join. Template words are ordered
by how many blocks of the whole corpus hold them, rarest first. With an overlap
of at least ``need = ceil(threshold * |template|)`` words:

* prefix filter: a match must hold one of the ``|template| - need + 1`` rarest
  words of the template, so only those are joined on;
* length filter: a block with fewer than ``need`` template words cannot match;
* positional filter: a shared word at position i of the template and j of the
  block leaves room for ``min(|template| - i, |block| - j)`` shared words, which
  must reach ``need``.

Surviving pairs are verified on the sets themselves. Only words of templates
are ever exploded, counts of them are as many as the templates have words, and
no two blocks are compared with each other.

Nulls and empty texts have no words and no labels. Repeated rows give repeated
results. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.common import LOWER, UPPER, distinct_sorted, landed, read

# Words, phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "cc-by": ("cc", "by"),
    "gpl": ("general", "public", "license"),
    "reserved": ("all", "rights", "reserved"),
}

#: Short public license notices, one set of words each.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of "
    "this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved-notice": "all rights reserved",
}
THRESHOLD = 0.85


def needed(size: int, threshold: float) -> int:
    """The smallest overlap that reaches the threshold of a set of this size."""
    return next(k for k in range(1, size + 1) if k >= threshold * size - 1e-9)


def _array(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _starts(label: str, words: tuple[str, ...]) -> str:
    """SQL text: the places where the phrase starts among the words ``w``."""
    same = " AND ".join(f"get(w, i + {k}) = '{x}'" for k, x in enumerate(words))
    places = f"filter(sequence(0, size(w) - {len(words)}), i -> {same})"
    # Most texts lack one of the words, which is cheaper to see.
    present = " AND ".join(f"contains(lowered, '{x}')" for x in words)
    found = f"if(size(w) >= {len(words)} AND {present}, {places}, array())"
    return f"transform({found}, i -> named_struct('word', i, 'label', '{label}'))"


def _read_once(docs: DataFrame, sets: dict[str, set[str]], phrases, threshold: float) -> DataFrame:
    """What the scan needs of each document, landed: places of phrases, and
    the blocks that hold enough template words, with those words only (others
    cannot add to an overlap)."""
    vocabulary = _array(sorted(set().union(*sets.values())))
    least = min(needed(len(s), threshold) for s in sets.values())
    words = f"array_intersect({vocabulary}, regexp_extract_all(line, r'{WORD}', 0))"
    per_line = f"transform(split(lowered, '\n'), (line, b) -> named_struct('block', b, 'words', {words}))"
    places = ", ".join(_starts(label, x) for label, x in phrases.items())
    scanned = (
        docs.selectExpr("doc_id", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS lowered")
        .selectExpr("doc_id", "lowered", f"regexp_extract_all(lowered, r'{WORD}', 0) AS w")
        .selectExpr(
            "doc_id",
            "monotonically_increasing_id() AS row",
            "size(w) AS n_words",
            f"concat({places}) AS places",
            f"filter({per_line}, x -> size(x.words) >= {least}) AS blocks",
        )
    )
    return landed(scanned, "license-scan")


def _matches(scanned: DataFrame, sets: dict[str, set[str]], threshold: float) -> DataFrame:
    spark = scanned.sparkSession
    found = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.words")
    vocabulary = sorted(set().union(*sets.values()))
    # One count per template word, so bounded by the templates.
    counts = {
        r["word"]: r["n"]
        for r in found.select(F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }

    def rank(word: str) -> tuple[int, str]:
        return counts.get(word, 0), word

    index = [
        (word, name, i, len(s), needed(len(s), threshold), sorted(s, key=rank))
        for name, s in sets.items()
        for i, word in enumerate(sorted(s, key=rank)[: len(s) - needed(len(s), threshold) + 1])
    ]
    # The index is made of the templates, a parameter: it does not grow with the corpus.
    prefix = spark.createDataFrame(
        index, "word string, template string, i int, size int, need int, whole array<string>"
    )
    ordered = f"array_intersect({_array(sorted(vocabulary, key=rank))}, words) AS words"
    return (
        found.selectExpr("row", "block", ordered)
        .select("*", F.posexplode("words").alias("j", "word"))
        .join(F.broadcast(prefix), "word")
        .where("size(words) >= need AND least(size - i, size(words) - j) >= need")
        .withColumn("shared", F.expr("array_intersect(words, whole)"))
        # A pair meets at each prefix word it shares; the first one counts.
        .where("get(shared, 0) = word AND size(shared) >= need")
        .selectExpr("row", "block", "template", "size(shared) / cast(size as double) AS containment")
    )


def _sets(templates: dict[str, str]) -> dict[str, set[str]]:
    return {name: set(text.split()) for name, text in templates.items()}


def template_matches(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, block, template, containment`` of every matching block."""
    sets = _sets(templates)
    scanned = _read_once(docs, sets, PHRASES, threshold)
    return (
        _matches(scanned, sets, threshold)
        .join(scanned.select("row", "doc_id"), "row")
        .select("doc_id", "block", "template", "containment")
    )


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    phrases: dict[str, tuple[str, ...]] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: its phrase places and matching templates.

    ``score`` is 1 where a phrase stands, else the largest containment of a
    matching template, else 0.
    """
    sets = _sets(templates)
    scanned = _read_once(docs, sets, phrases, threshold)
    # Grouped to one row per document and template before the join.
    held = (
        _matches(scanned, sets, threshold)
        .groupBy("row", "template")
        .agg(F.max("containment").alias("containment"), F.min("block").alias("block"))
        .groupBy("row")
        .agg(F.expr("collect_list(named_struct('template', template, 'block', block, "
                    "'containment', containment)) AS templates"))
    )
    return scanned.drop("blocks").join(held, "row", "left").drop("row")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = "transform(places, p -> p.label)"
    held = "coalesce(templates, array())"
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text")).selectExpr(
        "doc_id",
        "cast(n_words as bigint) AS n_words",
        "cast(size(places) as bigint) AS n_base",
        "cast(array_min(transform(places, p -> p.word)) as bigint) AS first_word",
        "cast(array_max(transform(places, p -> p.word)) as bigint) AS last_word",
        f"{distinct_sorted(base)} AS base_labels",
        f"{distinct_sorted(f'concat({base}, transform({held}, t -> t.template))')} AS labels",
        f"if(size(places) > 0, 1D, coalesce(array_max(transform({held}, t -> t.containment)), 0D))"
        " AS score",
    )


def op1_sql() -> str:
    """The same rows by comparing every line with every template."""
    word = WORD
    sets = _sets(TEMPLATES)
    need = {n: needed(len(s), THRESHOLD) for n, s in sets.items()}
    values = ", ".join(
        f"('{n}', [{', '.join(repr(w) for w in sorted(s))}], {need[n]})" for n, s in sets.items()
    )
    phrase = " UNION ALL ".join(
        f"SELECT r, i - 1 AS word, '{label}' AS label FROM places WHERE "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        for label, words in PHRASES.items()
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
  worded AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS w FROM docs),
  places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
  base AS ({phrase}),
  based AS (SELECT r, count(*) AS n, min(word) AS f, max(word) AS l, list(label) AS labels
    FROM base GROUP BY r),
  templates(template, words, need) AS (VALUES {values}),
  lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs),
  sets AS (SELECT r, list_distinct(regexp_extract_all(line, '{word}')) AS s FROM lines),
  held AS (SELECT r, list(template) AS labels,
      max(len(list_intersect(s, words)) / len(words)::DOUBLE) AS c
    FROM sets, templates WHERE len(list_intersect(s, words)) >= need GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word,
  l::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(based.labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(
    list_concat(coalesce(based.labels, []), coalesce(held.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM worded LEFT JOIN based USING (r) LEFT JOIN held USING (r)"""
