"""Quality rules (operator 5), by DataFrame functions alone.

Every document gets base statistics and a vector of four transformed ones:
``ln(mean word length)`` and the arcsine roots of the shares of symbols,
repeated lines and repeated words.  Per language and source a minimum
covariance determinant estimate (location, scatter) is fitted, and a document
whose squared Mahalanobis distance exceeds ``cutoff`` is rejected, as is one
that fails the base rules.

How the MCD is fitted without holding a group anywhere.  Two starts run side by
side: the coordinate-wise median and quartile range (a mergeable quantile
summary), and the mean and covariance of all rows.  A concentration step
computes all distances, and one aggregation by (group, distance bin) yields
counts, sums and products; a running count over a group's bins finds those of
the nearest ``h`` share (the last one counts in part, so that it is exactly
``h``), and their sums are the next location and scatter.  A group of any size
costs each task at most ``BINS`` rows.  Steps go on, for each group and start,
until the determinant no longer falls; the start of the least determinant
stands.  One reweighting step then takes the rows within ``inner`` (the 97.5 %
point).

Shrinkage.  As in the regularised MCD, scatters are shrunk to a target before
their determinant is taken: with ``n`` rows a group's location and scatter weigh
``n`` against the ``prior`` rows of the corpus's median and quartile ranges, and
``floors`` are added to the diagonal (most clean groups have no symbols at all,
and a scatter of zero would reject any).  So a group of any size, of one row
too, has an estimate of its own, by one rule: a large group's is its own
altogether, a tiny one's leans on the corpus.  All rows take part in all counts.

Parameter tables have a row per group; they are broadcast while their number
is at most ``broadcast_groups`` and joined by shuffle beyond it.

Defined cases.  Null or blank text has no words and fails the base rules; null
language or source is a group of its own; a null in any other column doesn't
matter.  Rows aren't merged: repeated rows and ids are judged one by one.  Rows
of equal distance share a bin.  An empty table gives an empty result; a group
whose rows all fail the base rules has no estimate, and needs none.
Further columns pass through (the operator's own replace any of their names).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store

DIMS = 4
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OWN = [*STATS, "base_failed", "kept", "distance"]
X = [f"__x{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
KEYS = ["__lang", "__source", "__start"]
PARAMS = [f"m{i}" for i in range(DIMS)] + [f"l{i}{j}" for i, j in PAIRS]
#: Makes the scatter of the nearest three quarters that of a normal sample (4 dimensions).
CONSISTENT = 1.485
BINS = 2048


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that stand twice or more in the text."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
        at = F.array_sort(F.transform(twice, lambda e: e["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(3), v - F.coalesce(F.get(p, k - 1), v - 3))), F.lit(0), lambda a, x: a + x))

    return F.when(F.size(w) < 4, 0).otherwise(let(F.array_sort(grams), covered))


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base statistics, natively and in one pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_store.WORD))
    words = let(
        _store.sql_words(text_col),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r")),
    )
    out = docs.drop(*OWN).withColumn("__words", words)
    return out.select(
        *[F.col(c) for c in docs.columns if c not in OWN],
        F.col("__words.n").alias("n_words"),
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col("__words.r").alias("n_repeat_words"),
        F.greatest(F.size(lines), F.lit(1)).alias("__lines"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> dict[str, Column]:
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    return dict(zip(X, (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "__lines"), share("n_repeat_words", "n_words")), strict=True))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution in the scatter's Cholesky factor."""
    y: list[Column] = []
    for i in range(DIMS):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, (v * v for v in y))


def _factor(groups: DataFrame) -> DataFrame:
    """The Cholesky factor of the scatter ``c{i}{j}``, column by column; each step is bound, so that none is written out twice."""
    names = [f"m{i}" for i in range(DIMS)] + [f"c{i}{j}" for i, j in PAIRS]
    state = F.struct(*names)
    for j in range(DIMS):

        def diagonal(s: Column) -> Column:
            root = reduce(lambda a, k: a - s[f"l{j}{k}"] * s[f"l{j}{k}"], range(j), s[f"c{j}{j}"])
            return F.struct(*(s[n].alias(n) for n in names), F.sqrt(F.greatest(root, F.lit(1e-12))).alias(f"l{j}{j}"))

        state = let(state, diagonal)
        names.append(f"l{j}{j}")

        def below(s: Column) -> Column:
            part = lambda i: reduce(lambda a, k: a - s[f"l{i}{k}"] * s[f"l{j}{k}"], range(j), s[f"c{i}{j}"])
            return F.struct(*(s[n].alias(n) for n in names), *((part(i) / s[f"l{j}{j}"]).alias(f"l{i}{j}") for i in range(j + 1, DIMS)))

        state = let(state, below)
        names += [f"l{i}{j}" for i in range(j + 1, DIMS)]
    out = groups.select(*KEYS, state.alias("__p"))
    det = reduce(lambda a, b: a + b, (2 * F.log(F.col(f"l{i}{i}")) for i in range(DIMS)))
    return out.select(*KEYS, *(F.col(f"__p.{n}").alias(n) for n in PARAMS)).withColumn("logdet", det)


def _moments(sums: DataFrame, target: dict, factor: float) -> DataFrame:
    """Location and scatter from counts, sums and products, shrunk to the target."""
    n, k = F.col("n"), target["prior"]
    raw = {f"r{i}": F.col(f"s{i}") / n for i in range(DIMS)}
    out = sums.withColumns(raw)
    mean = {f"m{i}": (n * F.col(f"r{i}") + k * target["m"][i]) / (n + k) for i in range(DIMS)}
    cov = {f"c{i}{j}": (n * (F.col(f"s{i}{j}") / n - F.col(f"r{i}") * F.col(f"r{j}")) * factor + (k * target["c"][i] if i == j else 0.0)) / (n + k) + (target["floors"][i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    return _factor(out.withColumns(mean | cov))


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.sum(X[i]).alias(f"s{i}") for i in range(DIMS)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS)]


def nearest(far: DataFrame, share: float) -> DataFrame:
    """Counts, sums and products of the nearest ``share`` of each fit's rows, by their ``__d``."""
    names = [f"s{i}" for i in range(DIMS)] + [f"s{i}{j}" for i, j in PAIRS]
    far = far.withColumn("__bin", F.least(F.lit(BINS - 1), F.floor(80 * F.log2(1 + 16 * F.col("__d")))).cast("int"))
    bins = far.groupBy(*KEYS, "__bin").agg(*_sums())
    by = ", ".join(KEYS)
    order = F.expr(f"sum(n) over (partition by {by} order by __bin rows between unbounded preceding and 1 preceding)")
    bins = bins.withColumns({"__before": F.coalesce(order, F.lit(0)), "__h": F.ceil(F.expr(f"sum(n) over (partition by {by})") * share)})
    part = F.least(F.lit(1.0), (F.col("__h") - F.col("__before")) / F.col("n"))
    near = bins.filter(F.col("__before") < F.col("__h")).withColumn("__part", part)
    return near.groupBy(*KEYS).agg(F.sum(F.col("n") * F.col("__part")).alias("n"), *(F.sum(F.col(s) * F.col("__part")).alias(s) for s in names))


def fit(rows: DataFrame, small: bool, floors: tuple[float, ...], share: float, inner: float, prior: float) -> DataFrame:
    """Parameters of every (``__lang``, ``__source``) group of ``rows``, whose vectors are ``X``."""
    hint = F.broadcast if small else (lambda d: d)
    group = KEYS[:2]
    quartiles = [F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in X]
    scale = lambda q: ((q[2] - q[0]) / 1.349) ** 2
    whole = rows.agg(*quartiles).first()  # four medians and quartile ranges
    whole = [whole[x] or (0.0, 0.0, 0.0) for x in X]
    target = {"prior": prior, "floors": floors, "m": [q[1] for q in whole], "c": [scale(q) for q in whole]}
    quart = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *quartiles).withColumn("__start", F.lit(0))
    start = {f"s{i}": F.col("n") * F.col(X[i])[1] for i in range(DIMS)}
    start |= {f"s{i}{j}": F.col("n") * (F.col(X[i])[1] * F.col(X[j])[1] + (scale(F.col(X[i])) if i == j else 0.0)) for i, j in PAIRS}
    robust = _moments(quart.withColumns(start), target, 1.0)
    plain = _moments(rows.groupBy(*group).agg(*_sums()).withColumn("__start", F.lit(1)), target, 1.0)
    # the first step's determinant is compared with none
    params = _store.materialize(robust.unionByName(plain).withColumn("logdet", F.lit(math.inf)), "quality-start")
    ended = []
    while True:
        far = rows.join(hint(params), group).withColumn("__d", _distance())
        after = _moments(_store.materialize(nearest(far, share), "quality-sums"), target, CONSISTENT)
        was = params.select(*KEYS, F.struct(*PARAMS, "logdet").alias("__was"))
        step = after.join(hint(was), KEYS).withColumn("__falls", F.col("logdet") < F.col("__was.logdet") - 1e-6)
        step = _store.materialize(step, "quality-step")
        ended.append(step.filter("NOT __falls").select(*KEYS, "__was.*"))
        params = step.filter("__falls").select(*KEYS, *PARAMS, "logdet")
        if params.isEmpty():
            break
    best = reduce(DataFrame.unionByName, ended)
    best = best.groupBy(*group).agg(F.min_by(F.struct("__start", *PARAMS), F.struct("logdet", "__start")).alias("x")).select(*group, "x.*")
    best = _store.materialize(best, "quality-mcd")
    near = rows.join(hint(best), group).filter(_distance() <= inner)
    return _moments(_store.materialize(near.groupBy(*KEYS).agg(*_sums()), "quality-sums"), target, 1.0).drop("__start", "logdet")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: float = 20.0, floors: tuple[float, ...] = (0.04, 0.045, 0.16, 0.14), share: float = 0.75, inner: float = 11.14, cutoff: float = 23.51, broadcast_groups: int = 50_000) -> DataFrame:
    """The columns of ``docs`` but its text, with the base statistics, ``base_failed``, ``distance`` (squared) and ``kept``."""
    spark, null = docs.sparkSession, F.lit("\x00")
    stats = base_statistics(docs, text_col).withColumns({"__lang": F.coalesce(F.col(lang_col).cast("string"), null), "__source": F.coalesce(F.col(source_col).cast("string"), null)})
    stats = _store.materialize(stats.drop(text_col), "quality-stats").withColumns(_vector())
    fitted = stats.filter(~F.col("base_failed")).select("__lang", "__source", *X)
    with _store.scratch(spark) as keep:
        small = fitted.select("__lang", "__source").distinct().count() <= broadcast_groups
        params = keep(_store.materialize(fit(fitted, small, floors, share, inner, prior), "quality-fit"))
    out = stats.join(F.broadcast(params) if small else params, ["__lang", "__source"], "left").withColumn("distance", _distance())
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
    return out.select(*[c for c in docs.columns if c not in OWN and c != text_col], *OWN)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = _store.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", *STATS, "base_failed", "kept")
