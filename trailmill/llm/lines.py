"""Line dedup with a fixed-depth tree of line templates.

A line's tokens, split at white space, lead down a tree of fixed depth: first
their number, then the ``DEPTH`` leading tokens. Tokens with digits stand for
variable fields and count as ``<*>`` from the start, so "page 3 of 9" and "page
4 of 9" are one template already.

Inside a leaf, further fields are found by comparing. ``SIMILARITY`` allows
``n - ceil(0.8 n)`` of a line's n tokens to be another's, so the tokens behind
the leading ones are cut into one segment more than that: whatever is alike
enough agrees in a whole segment. Lines that agree in a segment form a group;
the most frequent token of each position makes the group's template. A line
belongs to a template when at least ``SIMILARITY`` of its tokens are the
template's; of the templates it was compared with, it takes the one in most
documents. A line in no such template is its own.

A thousand lines that are all alike give about as many templates, which are all
alike too, so comparing every line with every template would grow with the square
of a group. Every line names its largest group. Lines are compared with the
templates of their own groups, and with each named template they share any
segment with. Only lines that no recurring template has taken then are compared
with all other templates they share a segment with, and the few templates these
lines reach are compared with all lines. So a line recurs exactly when, of all
templates, one it belongs to recurs.

A template that stands in at least ``MIN_DOCS`` documents of different text is
recurring; a line of more than ``LONG`` tokens recurs from two such documents on
that hold it word for word. The lines are dropped everywhere but at its first place: the first
such line of the document with the smallest id. Whole copies of a document are
not recurring lines: equal texts count once, near-duplicate stages handle them.

Counts are over all lines and are summed map-side, so a line that stands in a
third of all documents costs one row per task. Only lines whose leaf holds
another line are cut into segments, and groups of the same lines count once.
Lines are carried as 128-bit hashes; texts are shuffled twice, to look up example
lines and to apply the result.

Null texts stay null and have no lines. Blank lines are never dropped or
counted. Rows without doc_id count like others and sort first. Repeated rows
are equal texts and lose the same lines. Other columns, whatever their names,
stay as they are. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.common import landed, read

DEPTH = 3
SIMILARITY = 0.8
MIN_DOCS = 3
#: Lines of more tokens than this recur from two different texts on.
LONG = 50
#: Shorter lines have no room for a field of one token.
SHORTEST = 5
#: Groups of up to so many lines are one row each while their template is made;
#: larger ones are a row per line and token, so no row holds a large group.
FEW = 32
#: A token with a digit, matched from where the token begins.
FIELD = r"(?<!\\S)[^\\s\\d]*+\\d\\S*"


def _tokens(line: str) -> str:
    masked = f"if({line} rlike '\\\\d', regexp_replace({line}, '{FIELD}', '<*>'), {line})"
    return rf"filter(split({masked}, '\\s+'), t -> t <> '')"


def _segments() -> str:
    """SQL text: hashes of the segments of ``marks``, the n token hashes of a
    line of ``leaf``. One more than the tokens that may differ, as long as
    there are tokens."""
    parts = f"least(n - {DEPTH}, n - cast(ceil({SIMILARITY} * n - 1e-9D) as int) + 1)"
    begin = f"(n - {DEPTH}) * j div ({parts})"
    length = f"(n - {DEPTH}) * (j + 1) div ({parts}) - {begin}"
    return (
        f"transform(sequence(0, {parts} - 1), j -> xxhash64(leaf, j, "
        f"slice(marks, cast({DEPTH} + 1 + {begin} as int), cast({length} as int))))"
    )


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, content, line_no, tokens, n, k1, k2`` of lines that are not blank."""
    return (
        docs.where("text IS NOT NULL")
        .selectExpr("doc_id", "xxhash64(text) AS content", r"posexplode(split(text, '\n')) AS (line_no, line)")
        .where(r"line rlike '\\S'")  # a filter on the tokens would make them twice
        .selectExpr("doc_id", "content", "line_no", f"{_tokens('line')} AS tokens")
        .selectExpr("*", "size(tokens) AS n", "xxhash64(tokens) AS k1", "xxhash64(1, tokens) AS k2")
    )


def _marked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``k1, k2, docs, leaf, n, marks`` of lines that share their leaf, landed."""
    long = keys.where(f"n >= {SHORTEST}")
    crowded = long.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("leaf")
    wanted = (
        long.join(crowded, "leaf")
        .groupBy("first.doc_id", "first.content")
        .agg(F.collect_list(F.expr("struct(first.line_no AS line_no, k1, k2, docs, leaf, n)")).alias("wanted"))
    )
    texts = docs.where("text IS NOT NULL").selectExpr("doc_id AS d", "xxhash64(text) AS c", "text")
    same = F.expr("doc_id <=> d AND content = c")
    tokens = _tokens("line")
    return landed(
        texts.join(wanted.hint("merge"), same)  # grows with the corpus, so never broadcast
        .selectExpr(r"split(text, '\n') AS split", "wanted")
        .selectExpr("explode(transform(wanted, w -> struct(w AS of, split[w.line_no] AS line))) AS w")
        .selectExpr("w.of.k1", "w.of.k2", "w.of.docs", "w.of.leaf", "w.of.n", "w.line")
        .selectExpr("k1", "k2", "docs", "leaf", "n", f"transform({tokens}, t -> xxhash64(t)) AS marks")
        .dropDuplicates(["k1", "k2"]),  # repeated rows give a line twice
        "line-marks",
    )


def _members(segments: DataFrame) -> DataFrame:
    """``k1, k2, segment, lines``: the lines of all groups of several, landed."""
    several = (
        segments.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("lines"), F.expr("bit_xor(k1)").alias("x1"), F.expr("bit_xor(k2)").alias("x2"))
        .where("lines > 1")
        # Groups of the same lines have the same template.
        .groupBy("lines", "x1", "x2")
        .agg(F.min("segment").alias("segment"))
        .select("segment", "lines")
    )
    return landed(segments.join(several, "segment").select("k1", "k2", "segment", "lines"), "line-members")


def _groups(marked: DataFrame, members: DataFrame) -> DataFrame:
    """``segment, template, leaf, n, marks, named`` of all groups, landed;
    ``named`` by a line whose largest group it is."""
    named = members.groupBy("k1", "k2").agg(F.expr("max(struct(lines, segment)).segment AS segment"))
    shown = members.join(marked, ["k1", "k2"]).select("segment", "leaf", "n", "lines", "docs", "marks")
    held = "aggregate(rows, 0L, (sum, q) -> sum + if(get(q.marks, i) = get(r.marks, i), q.docs, 0L))"
    heavy = f"array_max(transform(rows, r -> struct({held} AS docs, get(r.marks, i) AS mark))).mark"
    agreed = "forall(rows, r -> get(r.marks, i) = get(rows[0].marks, i))"
    few = (
        shown.where(f"lines <= {FEW}")
        .groupBy("segment", "leaf", "n")
        .agg(F.collect_list(F.struct("docs", "marks")).alias("rows"))
        .selectExpr(
            "segment", "leaf", "n",
            f"transform(sequence(0, n - 1), i -> if({agreed}, get(rows[0].marks, i), {heavy})) AS marks",
        )
    )
    more = (
        shown.where(f"lines > {FEW}")
        .select("segment", "leaf", "n", "docs", F.posexplode("marks").alias("pos", "mark"))
        .groupBy("segment", "leaf", "n", "pos", "mark")
        .agg(F.sum("docs").alias("docs"))
        .groupBy("segment", "leaf", "n", "pos")
        .agg(F.expr("max(struct(docs, mark)).mark AS mark"))
        .groupBy("segment", "leaf", "n")  # as many entries as the lines have tokens
        .agg(F.expr("transform(array_sort(collect_list(struct(pos, mark))), x -> x.mark) AS marks"))
    )
    usual = (
        few.unionByName(more)
        .join(named.select("segment").distinct().withColumn("named", F.lit(True)), "segment", "left")
    )
    return landed(
        usual.selectExpr(
            "segment", "xxhash64(leaf, marks) AS template", "leaf", "n", "marks", "coalesce(named, false) AS named"
        ),
        "line-groups",
    )


def _reached(marked: DataFrame, segments: DataFrame, places: DataFrame, min_docs: int) -> DataFrame:
    """``k1, k2, template`` of lines and templates they belong to, landed: of a
    line that belongs to a recurring template, at least one recurring."""
    members = _members(segments)
    groups = _groups(marked, members)
    templates = landed(
        groups.groupBy("template").agg(
            F.max("named").alias("named"), *[F.first(c).alias(c) for c in ("leaf", "n", "marks")]
        ),
        "line-templates",
    )
    cut = F.explode(F.expr(_segments())).alias("segment")
    alike = "aggregate(zip_with(marks, usual, (a, b) -> if(a = b, 1, 0)), 0, (s, x) -> s + x)"

    def sharing(some: DataFrame, lines: DataFrame) -> DataFrame:
        return some.select("template", cut).join(lines, "segment").select("k1", "k2", "template")

    def near(met: DataFrame) -> DataFrame:
        return (
            met.distinct()
            .join(templates.selectExpr("template", "marks AS usual"), "template")
            .join(marked.select("k1", "k2", "marks"), ["k1", "k2"])
            .where(f"{alike} >= {SIMILARITY} * size(marks) - 1e-9D")
            .select("k1", "k2", "template")
        )

    own = members.join(groups.select("segment", "template"), "segment").select("k1", "k2", "template")
    first = landed(near(own.union(sharing(templates.where("named"), segments))), "line-reached")
    recurring = _totals(first, places).where(f"total >= {min_docs}")
    taken = first.join(recurring, "template", "left_semi").select("k1", "k2").distinct()
    rest = templates.where("NOT named")
    second = landed(near(sharing(rest, segments.join(taken, ["k1", "k2"], "left_anti"))), "line-left")
    third = near(sharing(rest.join(second, "template", "left_semi"), segments))
    return landed(first.union(third).distinct(), "line-belongs")


def _totals(reached: DataFrame, places: DataFrame) -> DataFrame:
    """``template, total``: in how many documents of different text it stands; one
    with several lines of a template counts once."""
    return (
        places.join(reached, ["k1", "k2"])
        .select("template", "content")
        .distinct()
        .groupBy("template")
        .agg(F.count(F.lit(1)).alias("total"))
    )


def _generalised(docs: DataFrame, keys: DataFrame, lines: DataFrame, min_docs: int) -> DataFrame:
    """``k1, k2, template`` of lines that belong to a recurring template, landed:
    that in most documents."""
    marked = _marked(docs, keys)
    cut = F.explode(F.expr(_segments())).alias("segment")
    segments = landed(marked.select("k1", "k2", cut), "line-segments")
    where = lines.select("k1", "k2", "content").join(marked.select("k1", "k2"), ["k1", "k2"], "left_semi")
    places = landed(where.distinct(), "line-places")
    reached = _reached(marked, segments, places, min_docs)
    return landed(
        reached.join(_totals(reached, places).where(f"total >= {min_docs}"), "template")
        .groupBy("k1", "k2")
        .agg(F.expr("max(struct(total, template)).template AS template")),
        "line-recurring",
    )


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, content, dropped`` (line numbers) of documents that lose lines."""
    leaf = f"xxhash64(n, slice(tokens, 1, {DEPTH})) AS leaf"
    lines = landed(
        _lines(docs.select("doc_id", "text")).selectExpr("doc_id", "content", "line_no", "n", "k1", "k2", leaf),
        "lines",
    )
    keys = landed(
        lines.groupBy("k1", "k2", "content")
        .agg(
            F.min(F.struct("doc_id", "content", "line_no")).alias("first"),
            *[F.first(c).alias(c) for c in ("n", "leaf")],
        )
        .groupBy("k1", "k2")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.min("first").alias("first"),
            *[F.first(c).alias(c) for c in ("n", "leaf")],
        ),
        "line-keys",
    )
    # Lines without others in a recurring template recur on their own count.
    alone = f"if(n > {LONG}, {min(2, min_docs)}, {min_docs})"
    general = _generalised(docs, keys, lines, min_docs)
    placed = keys.join(general, ["k1", "k2"], "left").select("k1", "k2", "n", "docs", "first", "template")
    shared = placed.where("template IS NOT NULL").groupBy("template").agg(F.min("first").alias("kept"))
    recurring = (
        placed.where(f"template IS NOT NULL OR docs >= {alone}")
        .join(shared, "template", "left")
        .selectExpr("k1", "k2", "coalesce(kept, first) AS kept")
    )
    here = "doc_id <=> kept.doc_id AND content = kept.content AND line_no = kept.line_no"
    return (
        lines.select("doc_id", "content", "line_no", "k1", "k2")
        .join(recurring, ["k1", "k2"])
        .where(f"NOT ({here})")
        .groupBy("doc_id", "content")
        .agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))
    )


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with only the kept lines as ``text``, and ``n_lines, n_dropped``
    behind the other columns."""
    lost = dropped_lines(docs, min_docs).selectExpr("doc_id AS d", "content AS c", "dropped AS gone")
    a = docs.alias("docs")
    met = a.join(
        lost.alias("lost").hint("merge"), F.expr("docs.doc_id <=> lost.d AND xxhash64(docs.text) = lost.c"), "left"
    )
    kept = r"""array_join(transform(filter(transform(split(docs.text, '\n'), (x, i) -> struct(i, x)),
        y -> NOT array_contains(lost.gone, y.i)), y -> y.x), '\n')"""
    text = F.expr(f"if(lost.gone IS NULL, docs.text, {kept})").alias("text")
    columns = [text if c.lower() == "text" else F.col(f"docs.`{c}`") for c in docs.columns]
    return met.select(
        *columns,
        F.expr(r"coalesce(size(split(docs.text, '\n')), 0) AS n_lines"),
        F.expr("coalesce(size(lost.gone), 0) AS n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
