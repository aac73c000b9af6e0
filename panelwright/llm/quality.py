"""Quality rules: exact base counts, then robust multivariate outliers by language and source.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FEATURES = ("x1", "x2", "x3", "x4")
#: Share of a group in the half-sample, concentration steps, least size of a group.
SHARE, STEPS, MIN_GROUP = 0.5, 4, 60
MAX_BROADCAST, SALTS = 20_000, 32
#: Smallest standard deviation of each transformed statistic: what ordinary texts vary by anyway.
FLOORS = (0.08, 0.05, 0.15, 0.15)
#: Chance that a row of a normal group lies beyond the cutoff.
TAIL = 1e-6


def _chi2_cdf(x: float, d: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def _chi2_sf_inverse(q: float, d: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        term = total = 1.0
        for k in range(1, d // 2):
            term *= mid / 2 / k
            total += term
        lo, hi = (mid, hi) if math.exp(-mid / 2) * total > q else (lo, mid)
    return (lo + hi) / 2


CUTOFF = _chi2_sf_inverse(TAIL, len(FEATURES))
#: Makes the covariance of the half-sample consistent at the normal model.
CONSISTENCY = SHARE / _chi2_cdf(_chi2_sf_inverse(1 - SHARE, len(FEATURES)), len(FEATURES) + 2)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word).

    Null and empty texts count 0 everywhere.  Each text is scanned inside its own row, so nothing
    is shuffled.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    x = docs.withColumn("_t", t)
    x = x.withColumns({
        "_w": F.filter(F.split("_t", SPACE), lambda w: w != ""),
        "_l": F.filter(F.split("_t", "\n"), lambda v: v.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": (F.size(F.split("_t", SYMBOL)) - 1).cast("long"),
    })
    x = x.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
    })
    h = F.col("_h")
    rolled = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    x = x.withColumn("_r", F.when(F.size(h) > WINDOW, rolled))
    r = F.col("_r")
    # most texts repeat no window; only the others are sorted
    x = x.withColumn("_s", F.when(F.size(F.array_distinct(r)) < F.size(r), F.sort_array(F.transform(r, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))))
    s = F.col("_s")
    twice = F.filter(s, lambda e, k: (e["v"] == F.get(s, k - 1)["v"]) | (e["v"] == F.get(s, k + 1)["v"]))
    x = x.withColumn("_p", F.sort_array(F.transform(twice, lambda e: e["i"])))
    p = F.col("_p")
    step = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
    repeat = F.aggregate(step, F.lit(0).cast("long"), lambda acc, v: acc + v)
    return x.withColumn("n_repeat_words", F.coalesce(repeat, F.lit(0)).cast("long")).drop("_t", "_w", "_l", "_h", "_r", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _features() -> dict[str, Column]:
    """Transformed statistics: each steadies the spread of a ratio and needs no length."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "x2": share("n_symbols", "word_chars"),
        "x3": share("n_dup_lines", "n_lines"),
        "x4": share("n_repeat_words", "n_words"),
    }


def _groups(stats: DataFrame) -> DataFrame:
    """The rows with a group key: language and source where it has ``MIN_GROUP`` rows; what is left of
    a language pooled; what is left then pooled once more."""
    fine = F.to_json(F.array(F.col("_lang"), F.col("_source")))
    n1 = stats.filter("NOT base_failed").groupBy("_lang", "_source").agg(F.count("*").alias("m"))
    n1 = n1.withColumn("rest", F.sum(F.when(F.col("m") < MIN_GROUP, F.col("m"))).over(_by("_lang")))
    key = F.when(F.col("m") >= MIN_GROUP, fine).when(F.col("rest") >= MIN_GROUP, F.to_json(F.array("_lang"))).otherwise(F.lit("[]"))
    return n1.select("_lang", "_source", key.alias("g"), "m")


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def _attach(rows: DataFrame, params: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table of one row a group, already written, to the rows of the groups.

    Up to ``MAX_BROADCAST`` groups it is broadcast; beyond that both sides are salted.  Either way a
    group with a third of all rows does not meet in one task, and what follows aggregates before it shuffles.
    """
    if params.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(params), keys, how)
    salted = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "_salt"], how).drop("_salt")


def _moments(rows: DataFrame) -> DataFrame:
    """Means and covariances by group from plain sums of deviations y_i from the centre before."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = rows.groupBy("g").agg(
        F.count("*").alias("m"), *[F.first(f"m_{x}").alias(f"m_{x}") for x in FEATURES],
        *[F.sum(f"y_{i}").alias(f"a_{i}") for i in range(len(FEATURES))],
        *[F.sum(F.col(f"y_{i}") * F.col(f"y_{j}")).alias(f"q_{i}_{j}") for i, j in pairs],
    )
    n = F.col("m")

    def cov(i: int, j: int) -> Column:
        c = F.col(f"q_{i}_{j}") / n - (F.col(f"a_{i}") / n) * (F.col(f"a_{j}") / n)
        return (c * CONSISTENCY + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"s_{i}_{j}")

    means = [(F.col(f"m_{x}") + F.col(f"a_{i}") / n).alias(f"m_{x}") for i, x in enumerate(FEATURES)]
    return _factor(sums.select("g", "m", *means, *[cov(i, j) for i, j in pairs]))


def _factor(p: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the covariance s_i_j; the floors keep it regular."""
    d = len(FEATURES)
    for j in range(d):
        own = F.col(f"s_{j}_{j}") - sum((F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        p = p.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(own, F.lit(1e-12))))
        for i in range(j + 1, d):
            rest = F.col(f"s_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            p = p.withColumn(f"l_{i}_{j}", rest / F.col(f"l_{j}_{j}"))
    return p


def _with_distance(df: DataFrame) -> DataFrame:
    """Adds the deviations y_i and the squared robust distance d2, solving for one z_i a layer."""
    df = df.withColumns({f"y_{i}": F.col(x) - F.col(f"m_{x}") for i, x in enumerate(FEATURES)})
    for i in range(len(FEATURES)):
        rest = sum((F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"z_{i}", (F.col(f"y_{i}") - rest) / F.col(f"l_{i}_{i}"))
    return df.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(FEATURES))), F.lit(0.0)))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and median absolute deviations of each group, as a diagonal first estimate."""
    mid = lambda c: F.percentile_approx(c, 0.5, 10_000)
    med = rows.groupBy("g").agg(F.count("*").alias("m"), *[mid(x).alias(f"m_{x}") for x in FEATURES])
    med = stage_table(med, "medians")
    off = _attach(rows, med, ["g"]).groupBy("g").agg(*[mid(F.abs(F.col(x) - F.col(f"m_{x}"))).alias(f"d_{x}") for x in FEATURES])
    p = med.join(off, "g")
    zero = {f"s_{i}_{j}": (F.col(f"d_{a}") * 1.4826) ** 2 + FLOORS[i] ** 2 if i == j else F.lit(0.0) for i, a in enumerate(FEATURES) for j in range(i + 1)}
    return _factor(p.withColumns(zero))


def estimates(stats: DataFrame, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimates by group: one row a group.

    From the medians, each concentration step keeps the ``SHARE`` of a group nearest to the present
    centre and takes its mean and covariance, which never enlarges the determinant.  The share's
    edge is a bounded quantile sketch, so no group is gathered in one task.  With no ``steps`` the
    first estimate stays.
    """
    rows = stats.filter("NOT base_failed").select("g", *FEATURES)
    params = stage_table(_start(rows), "mcd")
    for _ in range(steps):
        at = _with_distance(_attach(rows, params, ["g"])).select("g", "d2", *[f"m_{x}" for x in FEATURES], *[f"y_{i}" for i in range(len(FEATURES))])
        edge = stage_table(at.groupBy("g").agg(F.percentile_approx("d2", SHARE, 10_000).alias("edge")), "edges")
        params = stage_table(_moments(_attach(at, edge, ["g"]).filter("d2 <= edge")), "mcd")
    return params


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, plus the base counts, base_failed, distance and kept.

    A row passes the base rules unless it has fewer than 20 words or more than 30 per cent of its words
    stand in repeated eight-word windows.  Of the rest those whose squared robust distance in their
    group exceeds the chi-square cutoff are rejected.  Null language or source is a value of its own.  Where
    the last pool has under ``MIN_GROUP`` rows, they are judged by the estimates of all rows; a table with
    under ``MIN_GROUP`` rows in all, by its medians and median absolute deviations with the floors.  Null texts have no words
    and fail the base rules; repeated rows get equal verdicts; an empty table gives an empty
    result.  Columns of the names added are replaced.
    """
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "kept", "distance", "g", *FEATURES)
    src = docs.drop(*own)
    for c in ("lang", "source"):
        src = src.withColumn(f"_{c}", F.coalesce(F.col(c).cast("string"), F.lit("\x00")) if c in docs.columns else F.lit(""))
    stats = base_counts(src.withColumn("_key", F.xxhash64("text"))).drop("text").withColumn("base_failed", base_failed()).withColumns(_features())
    stats = stage_table(stats, "quality")
    groups = stage_table(_groups(stats), "groups")
    total, left = (v or 0 for v in groups.agg(F.sum("m"), F.sum(F.when(F.col("g") == "[]", F.col("m")))).first())
    keyed = _attach(stats, groups.drop("m"), ["_lang", "_source"], "left")
    rows = keyed
    if 0 < left < MIN_GROUP:
        rows = keyed.unionByName(keyed.filter("g <> '[]'").withColumn("g", F.lit("[]")))
    params = estimates(rows, STEPS if total >= MIN_GROUP else 0).drop("m")
    out = _with_distance(_attach(keyed, stage_table(params, "mcd"), ["g"], "left")).withColumnRenamed("d2", "distance")
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= F.lit(CUTOFF)))
    return out.withColumn("kept", kept).select(*[c for c in src.columns if c not in ("text", "_lang", "_source")], "_key", *own[:6], "base_failed", "distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    bad = judge(docs.select(*[c for c in ("doc_id", "text", "lang", "source") if c in docs.columns])).filter("NOT kept")
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"))
    return docs.join(bad, docs.doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(docs.text) == F.col("_k")), "left_anti")
