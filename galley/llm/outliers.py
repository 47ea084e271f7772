"""Quality rules as robust multivariate outliers: minimum covariance determinant per language and source.

Built from DataFrame expressions only. A document becomes a vector of five transformed statistics; each (language, source)
group gets a centre and a scatter from the three quarters of its documents that lie closest to that centre (concentration
steps), and documents whose Mahalanobis distance is beyond the limit are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.common import checkpointed, pick

WORDS = "[^\\x20\\x09-\\x0D]+"
GAPS = "[\\x20\\x09-\\x0D]+"
#: The positions of 3-word windows are packed under their hash: 24 bits. Texts of more words keep hash and position apart.
POSITION_BITS = 24
AXES = ("length", "word_size", "symbols", "lines", "repeats")
#: Added to the variance of each axis: what a difference must exceed to count where almost all documents are equal.
FLOOR = {"length": 0.3, "word_size": 0.05, "symbols": 0.1, "lines": 0.1, "repeats": 0.1}


def window_hash(words: str = "words", at: str = "i") -> str:
    """SQL for the hash that brings equal 3-word windows together."""
    return f"xxhash64({words}[{at}], {words}[{at} + 1], {words}[{at} + 2])"


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` of every text; null text has none."""
    rows = pick(df, key, *keep, text).withColumn(text, F.coalesce(F.col(text), F.lit("")))
    base = rows.select(
        key,
        *keep,
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.filter(F.split(text, GAPS, -1), lambda x: x != "").alias("words"),
    )
    long = f"size(words) > {1 << POSITION_BITS}"
    windows = F.expr(
        f"""if(size(words) < 3 or {long}, cast(array() as array<bigint>),
            transform(sequence(0, size(words) - 3), i -> shiftleft({window_hash()}, {POSITION_BITS}) + i))"""
    )
    apart = F.expr(
        f"""if(size(words) < 3 or not {long}, cast(array() as array<struct<h: bigint, i: int>>),
            transform(sequence(0, size(words) - 3), i -> named_struct('h', {window_hash()}, 'i', i)))"""
    )
    sorted_ = base.select("*", F.sort_array(windows).alias("s"), F.sort_array(apart).alias("a"))
    # Only windows that have a neighbour of the same hash go on.
    twin = f"shiftright(x ^ get(s, i + 1), {POSITION_BITS}) = 0 or shiftright(x ^ get(s, i - 1), {POSITION_BITS}) = 0"
    twins = sorted_.select(*[c for c in sorted_.columns if c != "s"], F.expr(f"filter(s, (x, i) -> {twin})").alias("s"))
    # Windows are equal if hash and words are equal: the words decide, the hash only brings equals together.
    mask = (1 << POSITION_BITS) - 1
    same = f"""(a, b) -> a is not null and b is not null and shiftright(a ^ b, {POSITION_BITS}) = 0
        and words[cast(a & {mask} as int)] = words[cast(b & {mask} as int)]
        and words[cast(a & {mask} as int) + 1] = words[cast(b & {mask} as int) + 1]
        and words[cast(a & {mask} as int) + 2] = words[cast(b & {mask} as int) + 2]"""
    near = twins.select("*", F.expr(f"zip_with(s, slice(s, 2, size(s)), {same})").alias("eq"))
    # Equal windows may have others of the same hash between them: where no neighbour is equal, the whole list is looked through.
    other = f"""exists(s, y -> y <> x and shiftright(x ^ y, {POSITION_BITS}) = 0 and words[cast(x & {mask} as int)] = words[cast(y & {mask} as int)]
        and words[cast(x & {mask} as int) + 1] = words[cast(y & {mask} as int) + 1] and words[cast(x & {mask} as int) + 2] = words[cast(y & {mask} as int) + 2])"""
    hit = near.select("*", F.expr(f"sort_array(transform(filter(s, (x, i) -> eq[i] or coalesce(get(eq, i - 1), false) or {other}), x -> x & {mask}))").alias("p"))
    alike = "x.h = {0}.h and words[x.i] = words[{0}.i] and words[x.i + 1] = words[{0}.i + 1] and words[x.i + 2] = words[{0}.i + 2]"
    after, ahead = "get(a, k + 1)", "get(a, k - 1)"
    twin_far = f"(coalesce({after}.h = x.h, false) or coalesce({ahead}.h = x.h, false)) and exists(a, y -> y.i <> x.i and {alike.format('y')})"
    far = f"filter(a, (x, k) -> coalesce({alike.format(after)}, false) or coalesce({alike.format(ahead)}, false) or ({twin_far}))"
    hit = hit.withColumn("p", F.expr(f"if({long}, sort_array(transform({far}, x -> cast(x.i as bigint))), p)"))
    covered = F.expr("coalesce(aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(coalesce(b - a, 3), 3)), 0L, (t, x) -> t + x), 0L)")
    return hit.select(
        key,
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def axes() -> dict[str, Column]:
    """The transformed statistics, on a grid of 1/1000 so that exact quantiles need few distinct values."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    raw = {
        "length": F.log(words),
        "word_size": F.log(chars / words),
        "symbols": F.log1p(20 * F.col("n_symbols") / chars),
        "lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
    }
    return {k: F.round(v, 3) for k, v in raw.items()}


def _factor(cov: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    """Cholesky factor of the scatter as expressions over columns already named l_i_j."""
    out = {}
    for i in range(len(AXES)):
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}")
    return out


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the group's centre m_i under its factor l_i_j."""
    for i in range(len(AXES)):
        rest = F.col(AXES[i]) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        df = df.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return df.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(AXES))), F.lit(0.0)))


def _estimate(rows: DataFrame, group: list[str]) -> DataFrame:
    """Centre and Cholesky factor of each group's rows, from additive moments: one partial aggregation."""
    n = len(AXES)
    sums = rows.groupBy(*group).agg(
        F.count("*").alias("n"),
        *[F.sum(a).alias(f"s_{i}") for i, a in enumerate(AXES)],
        *[F.sum(F.col(AXES[i]) * F.col(AXES[j])).alias(f"s_{i}_{j}") for i in range(n) for j in range(i + 1)],
    )
    out = sums.withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") for i in range(n)})
    cov = {(i, j): F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}") + (FLOOR[AXES[i]] ** 2 if i == j else 0.0) for i in range(n) for j in range(i + 1)}
    for (i, j), e in _factor(cov).items():
        out = out.withColumn(f"l_{i}_{j}", e)
    return out.select(*group, *[f"m_{i}" for i in range(n)], *[f"l_{i}_{j}" for i in range(n) for j in range(i + 1)])


def _start(rows: DataFrame, group: list[str]) -> DataFrame:
    """First estimate: medians, and median absolute deviations on the diagonal."""
    n = len(AXES)
    mid = rows.groupBy(*group).agg(*[F.expr(f"percentile({a}, 0.5)").alias(f"m_{i}") for i, a in enumerate(AXES)])
    off = rows.join(mid, group).groupBy(*group).agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(n)],
        *[F.expr(f"percentile(abs({a} - m_{i}), 0.5)").alias(f"d_{i}") for i, a in enumerate(AXES)],
    )
    scale = {f"l_{i}_{j}": F.sqrt((1.4826 * F.col(f"d_{i}")) ** 2 + FLOOR[AXES[i]] ** 2) if i == j else F.lit(0.0) for i in range(n) for j in range(i + 1)}
    return off.select(*group, *[f"m_{i}" for i in range(n)], *[e.alias(k) for k, e in scale.items()])


def _bin(d2: Column) -> Column:
    """ln d2 on a grid of 1/64: what a group's quantile of distances is taken over."""
    return F.floor(F.log(d2 + 1e-6) * 64).cast("long")


def minimum_covariance(rows: DataFrame, group: list[str], share: float = 0.75, steps: int = 3) -> DataFrame:
    """Centre and factor of each group by concentration steps: estimate, take the ``share`` closest rows, estimate again.

    Quantiles are exact over gridded distances and moments are sums, so the hottest group is pre-aggregated in every task.
    """
    params = checkpointed(_start(rows, group))
    for _ in range(steps):
        near = _distance(rows.join(params, group)).select(*group, *AXES, _bin(F.col("d2")).alias("bin"))
        limit = near.groupBy(*group).agg(F.expr(f"percentile(bin, {share})").alias("limit"))
        params = checkpointed(_estimate(near.join(limit, group).where(F.col("bin") <= F.col("limit")), group))
    return params


def robust_outliers(
    df: DataFrame, key: str = "doc_id", text: str = "text", group: tuple[str, str] = ("lang", "source"), share: float = 0.75, steps: int = 3,
    least_words: int = 50, most_repeated: int = 50, least_group: int = 50, cutoff: float = 20.515,
) -> DataFrame:
    """One row per document with its statistics, ``base_failed``, its distance ``d2`` and ``kept``.

    ``base_failed``: fewer than ``least_words`` words or more than ``most_repeated`` percent of them in repeated 3-word
    windows. Those documents do not shape the estimates. The rest is kept if d2, divided by the group's median d2 over its
    expected value, is at most ``cutoff`` (chi-square with five degrees exceeds 20.515 once in 1000 rows). A group of fewer than
    ``least_group`` such documents uses its language's estimate, a language with fewer the estimate of all.

    Null language or source is a group of its own; null and empty texts fail the base rule; repeated rows count as often as
    they occur; an empty table gives no rows; other columns are ignored.
    """
    lang, source = group
    stats = statistics(df, key, text, group)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumns(axes())
    # A null is a group apart from the empty name.
    named = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    stats = checkpointed(stats.withColumns({lang: named(lang), source: named(source)}))
    clean = stats.where(~F.col("base_failed"))
    # Each group is estimated from its own rows, or from the next wider group that is large enough.
    sizes = clean.groupBy(lang, source).agg(F.count("*").alias("n"))
    wide = sizes.groupBy(lang).agg(F.sum("n").alias("n_lang"))
    level = sizes.join(wide, lang).select(
        lang,
        source,
        F.when(F.col("n") >= least_group, F.concat_ws("\x00", F.lit("g"), lang, source)).when(F.col("n_lang") >= least_group, F.concat_ws("\x00", F.lit("l"), lang)).otherwise(F.lit("all")).alias("model"),
    )
    level = checkpointed(level)
    models = level.select("model").distinct()
    own = clean.select(lang, source, *AXES).join(level.where(F.col("model").startswith("g")), [lang, source]).select("model", *AXES)
    by_lang = clean.select(F.concat_ws("\x00", F.lit("l"), lang).alias("model"), *AXES).join(models, "model", "left_semi")
    everything = clean.select(F.lit("all").alias("model"), *AXES).join(models, "model", "left_semi")
    vectors = own.unionByName(by_lang).unionByName(everything)
    params = minimum_covariance(vectors, ["model"], share, steps)
    # Rescale so that half of a group's documents lie within the median of chi-square with five degrees.
    bins = _distance(vectors.join(params, "model")).select("model", _bin(F.col("d2")).alias("bin"))
    spread = bins.groupBy("model").agg(F.greatest(F.exp((F.expr("percentile(bin, 0.5)") + 0.5) / 64) / F.lit(4.351), F.lit(1.0)).alias("scale"))
    judged = checkpointed(level.join(params.join(spread, "model"), "model").drop("model"))
    scored = _distance(stats.join(judged, [lang, source], "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") / F.col("scale") <= cutoff, F.lit(True))
    return scored.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), (F.col("d2") / F.col("scale")).alias("d2"))
