"""Quality rules as a learned decision list, native to Spark SQL.

Statistics of every document are Spark expressions. A list of rules is learned
from labelled documents by sequential covering: a rule grows as a conjunction of
thresholds with the best information gain on two thirds of the examples, is pruned
back on the other third, and the examples it covers are set aside before the next
rule. The list becomes one ``CASE WHEN`` expression over the statistics.

Defined results: null or blank text has no words, fails the base rules and is not
kept; null ``doc_id`` stays as a row; repeated rows are judged each; no labels (or
only one class) give an empty list, so the base rules decide alone; labels that
contradict each other for a document count as quality 0. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.scratch import folder

#: Bound on the labelled documents that a list is learned from (those with the smallest hash of doc_id).
LEARN_ROWS = 20_000
MAX_RULES, MAX_TERMS = 12, 4
MIN_COVER, MIN_PRECISION = 8, 0.9
_PROBS = [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.84, 0.88, 0.9, 0.92, 0.94, 0.96, 0.98, 0.99]
_WS = r"[ \t\n\x0B\f\r]+"
_BLANKS = " \t\n\x0b\f\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_words", "f_word_len", "f_symbols", "f_upper", "f_digits", "f_marks", "f_dup_lines", "f_repeat")


def _kept_chars(text: Column, chars: str) -> Column:
    """Number of characters of the class ``chars``; runs of others are cut in one step each."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def statistics(docs: DataFrame, also: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id with the counts of ``BASE`` and the ratios of ``FEATURES``; ``also``: named columns of docs to go along."""
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"), *also)
    own = d.columns[2:]
    trimmed = F.btrim(F.col("t"), F.lit(_BLANKS))
    d = d.select(
        "doc_id",
        *own,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WS)).alias("w"),
        F.filter(F.split(F.col("t"), "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "").alias("lines"),
        F.regexp_replace("t", "[^A-Z0-9#*$%&|<>!?]+", "").alias("marks"),
    )
    d = d.select(
        "doc_id",
        *own,
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _kept_chars(F.col("marks"), "#*$%&|<>").alias("n_symbols"),
        _kept_chars(F.col("marks"), "A-Z").alias("n_upper"),
        _kept_chars(F.col("marks"), "0-9").alias("n_digits"),
        _kept_chars(F.col("marks"), "!?").alias("n_marks"),
        F.expr("if(size(w) < 3, cast(array() as array<bigint>), transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])))").alias("windows"),
    )
    twice = F.expr("array_sort(transform(windows, (x, i) -> named_struct('h', x, 'i', i)))")
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), twice))
    d = d.withColumn(
        "starts",
        F.expr(
            """filter(sorted, (x, k) -> (k > 0 and sorted[greatest(k - 1, 0)].h = x.h)
               or (k + 1 < size(sorted) and sorted[least(k + 1, size(sorted) - 1)].h = x.h)).i"""
        ),
    )
    d = d.withColumn(
        "n_repeat",
        F.expr("coalesce(size(array_distinct(flatten(transform(starts, p -> array(p, p + 1, p + 2))))), 0)"),
    )
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n", "word_chars", "n_lines"))
    repeat = F.when(F.col("starts").isNull(), 0).otherwise(F.col("n_repeat"))
    found = F.struct(
        F.col("n").cast("long").alias("n_words"),
        *(F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines")),
        repeat.cast("long").alias("n_repeat_words"),
        F.col("n").cast("double").alias("f_words"),
        (F.col("word_chars") / words).alias("f_word_len"),
        (F.col("n_symbols") / chars).alias("f_symbols"),
        (F.col("n_upper") / chars).alias("f_upper"),
        (F.col("n_digits") / chars).alias("f_digits"),
        (F.col("n_marks") / words).alias("f_marks"),
        (F.col("n_dup_lines") / lines).alias("f_dup_lines"),
        (repeat / words).alias("f_repeat"),
    )
    # A later filter would be pushed below these steps and copy all their expressions into itself; a generator isn't.
    return d.select("doc_id", *own, F.explode_outer(F.array(found)).alias("found")).select("doc_id", *own, "found.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _cells(stats: DataFrame) -> tuple[dict[str, list[float]], list[tuple]]:
    """Cut points of each feature, and the examples counted by (bins, fold): at most one cell per example."""
    # exact, so that they don't hang on how the rows are dealt out; the rows are bounded
    points = stats.agg(*(F.percentile(f, F.array(*map(F.lit, _PROBS))).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(points[f] or ())) for f in FEATURES}
    bins = [
        sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias(f"b_{f}") if cuts[f] else F.lit(0).alias(f"b_{f}")
        for f in FEATURES
    ]
    grouped = (
        stats.select(*bins, F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).alias("fold"), "bad")
        .groupBy(*(f"b_{f}" for f in FEATURES), "fold")
        .agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    )
    return cuts, [tuple(r) for r in grouped.collect()]


def _covers(cell: tuple, terms: list[tuple]) -> bool:
    return all((cell[f] > b) == above for f, b, above in terms)


def _counts(cells: list[tuple], terms: list[tuple]) -> tuple[int, int]:
    bad = total = 0
    for c in cells:
        if _covers(c, terms):
            bad, total = bad + c[-1], total + c[-2]
    return bad, total - bad


def _best_term(cells: list[tuple], sizes: list[int]) -> tuple | None:
    """The threshold with the largest information gain over the cells, all of one rule."""
    p0, n0 = sum(c[-1] for c in cells), sum(c[-2] - c[-1] for c in cells)
    if not p0 or not n0:
        return None
    start, best, found = math.log2(p0 / (p0 + n0)), 1e-9, None
    for f, size in enumerate(sizes):
        pos, neg = [0] * (size + 1), [0] * (size + 1)
        for c in cells:
            pos[c[f]] += c[-1]
            neg[c[f]] += c[-2] - c[-1]
        p = n = 0
        for b in range(size):
            p, n = p + pos[b], n + neg[b]
            for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                if x >= MIN_COVER and (gain := x * (math.log2(x / (x + y)) - start)) > best:
                    best, found = gain, (f, b, above)
    return found


def learn(stats: DataFrame) -> list[list[tuple[str, str, float]]]:
    """Ordered rules that reject; each is a list of (feature, '>' or '<=', threshold).

    ``stats``: the features and ``bad`` (1: quality 0) of a bounded set of labelled documents.
    """
    cuts, cells = _cells(stats)
    sizes = [len(cuts[f]) for f in FEATURES]
    k = len(FEATURES)
    grow, prune = [c for c in cells if c[k] != 0], [c for c in cells if c[k] == 0]
    rules: list[list[tuple]] = []
    while len(rules) < MAX_RULES and sum(c[-1] for c in grow) >= MIN_COVER:
        terms, inside = [], grow
        while len(terms) < MAX_TERMS and (term := _best_term(inside, sizes)):
            terms.append(term)
            inside = [c for c in inside if _covers(c, [term])]
        worth = lambda t: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_counts(prune, t))
        if terms:
            terms = max((terms[:i] for i in range(1, len(terms) + 1)), key=lambda t: (worth(t), -len(t)))
        p, n = _counts(grow + prune, terms) if terms else (0, 1)
        if not terms or p + n < MIN_COVER or p / (p + n) < MIN_PRECISION:
            break
        rules.append(terms)
        grow = [c for c in grow if not _covers(c, terms)]
        prune = [c for c in prune if not _covers(c, terms)]
    return [[(FEATURES[f], ">" if above else "<=", cuts[FEATURES[f]][b]) for f, b, above in t] for t in rules]


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """True where no rule rejects: the ordered rules as one conditional expression."""
    out = None
    for terms in rules:
        held = F.lit(True)
        for feature, sign, at in terms:
            held &= (F.col(feature) > F.lit(at)) if sign == ">" else (F.col(feature) <= F.lit(at))
        out = F.when(held, False) if out is None else out.when(held, False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """Statistics and ``bad`` of at most ``rows`` labelled documents, those with the smallest hash of doc_id."""
    chosen = (
        labels.select("doc_id", "quality")
        .dropna()
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # At most ``rows`` pairs of numbers: bounded, so the texts needn't be shuffled.
    return statistics(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id")


def learned(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> list[list[tuple[str, str, float]]]:
    folder(docs.sparkSession)
    return learn(labelled(docs, labels, rows).drop(*BASE).checkpoint())


def accepted(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rules = learned(docs, labels, rows)
    judged = statistics(docs, (F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"),))
    return judged.where(~base_failed() & verdict(rules)).select(*(F.col(f"own.`{c}`").alias(c) for c in docs.columns))


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """doc_id, the counts of ``BASE``, base_failed and kept for every document."""
    rules = learned(docs, labels, rows)
    return statistics(docs).select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
