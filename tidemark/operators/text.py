"""Posts: cleaning, lexicon scores, tagging, hourly sentiment, engagement; archives of posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import salted_join
from tidemark.functions.windows import affine_scans, kalman_gain, ordered, span_alpha
from tidemark.operators.candles import bucket, hour_grid

PUNCTUATION = ".,!?;:()[]{}\"'"


def post_text(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    return df.withColumn("post_text", F.trim(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))))


def lexicon_score(df: DataFrame, text: str, positive: Sequence[str], negative: Sequence[str], out: str = "sentiment_score") -> DataFrame:
    """(positive - negative) / (positive + negative) of a text's words; 0 where none is in the lexicon."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    up = F.size(F.filter(words, lambda w: w.isin(*positive))).cast("double")
    down = F.size(F.filter(words, lambda w: w.isin(*negative))).cast("double")
    rows = df.withColumn("_up", up).withColumn("_dn", down)
    return rows.withColumn(out, F.coalesce(F.try_divide(F.col("_up") - F.col("_dn"), F.col("_up") + F.col("_dn")), F.lit(0.0))).drop("_up", "_dn")


def score_distinct(df: DataFrame, text: str, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """Scores each distinct text once and joins the score back."""
    once = lexicon_score(df.select(F.col(text).alias("_t")).where("_t is not null").distinct(), "_t", positive, negative)
    keyed = once.withColumn("_h", F.xxhash64("_t"))
    rows = df.withColumn("_h", F.xxhash64(text))
    return rows.join(keyed, (rows["_h"] == keyed["_h"]) & (rows[text] == keyed["_t"]), "left").drop("_h", "_t")


def tag_symbols(df: DataFrame, text: str, keywords: dict[str, Sequence[str]]) -> DataFrame:
    """One row for each symbol whose keywords stand in the text as whole words."""
    import re

    tags = F.array_compact(F.array(*[F.when(F.lower(text).rlike(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)"), F.lit(s)) for s, words in keywords.items()]))
    return df.withColumn("symbol", F.explode(tags))


def lexicon_scores(df: DataFrame, key: str, text: str, lexicon: DataFrame, out: str = "sentiment_score", salts: int = 16) -> DataFrame:
    """key and score of every row, by a lexicon that is a table (word, weight): the sum of the weights of its words over
    the sum of their magnitudes, 0 where none is listed. A lexicon of any size is a join, after which a task adds up the
    listed words of its rows; those of a frequent word go to many tasks. A word listed twice counts with the sum of its
    weights."""
    split = F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"))
    words = df.select(key, split.alias("_w")).select(key, F.btrim("_w", F.lit(PUNCTUATION)).alias("word"))
    weights = lexicon.groupBy("word").agg(F.sum(F.col("weight").cast("double")).alias("_weight"))
    sums = salted_join(words, weights, ["word"], salts).groupBy(key).agg(F.sum("_weight").alias("_s"), F.sum(F.abs("_weight")).alias("_a"))
    scored = df.select(key).distinct().join(sums, key, "left")
    return scored.select(key, F.coalesce(F.try_divide("_s", F.nullif("_a", F.lit(0.0))), F.lit(0.0)).alias(out))


def tag_by_patterns(df: DataFrame, key: str, text: str, patterns: DataFrame, longest: int = 5, salts: int = 16) -> DataFrame:
    """key, symbol of every row whose text holds a pattern (symbol, pattern) as whole words in a row, whatever stands
    between the words. Patterns are a table, found by all their words; those of more than ``longest`` words, or of none,
    are an error, as a row would have to carry more of its text. A row's words meet the words behind them as columns, so
    the work is linear in its length."""
    known = patterns.select("symbol", F.regexp_extract_all(F.lower("pattern"), F.lit(r"\w+"), 0).alias("_p")).distinct()
    counts = {r["n"]: r["count"] for r in known.groupBy(F.size("_p").alias("n")).count().collect()}  # one row a length
    bad = sum(c for n, c in counts.items() if not 1 <= n <= longest)
    if bad:
        raise ValueError(f"{bad} patterns have no word or more than {longest}")
    lengths = sorted(counts) or [1]
    words = df.select(key, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\w+"), 0).alias("_t"))
    behind = [F.slice("_t", k + 1, F.greatest(F.size("_t"), F.lit(1))).alias(f"_w{k}") for k in range(lengths[-1])]
    zipped = words.select(key, *behind).select(key, F.explode(F.arrays_zip(*[f"_w{k}" for k in range(lengths[-1])])).alias("_z"))
    runs = [F.when(F.col(f"_z._w{n - 1}").isNotNull(), F.concat_ws(" ", *[F.col(f"_z._w{k}") for k in range(n)])) for n in lengths]
    here = zipped.select(key, (F.explode(F.array(*runs)) if len(runs) > 1 else runs[0]).alias("_here")).where("_here is not null")
    found = salted_join(here, known.select("symbol", F.array_join("_p", " ").alias("_here")), ["_here"], salts)
    return found.select(key, "symbol").distinct()


def dedup_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key, by an order that leaves no choice."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def append_new(existing: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """existing and the batch's rows with keys not seen before."""
    if key not in existing.columns or key not in batch.columns:
        raise ValueError(f"both tables need the column {key}")
    return existing.unionByName(dedup_first(batch, key, order).join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_posts(archive: DataFrame, rolling: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The archive and the rolling set as one: each key once, the archive's row first, of several the first by order."""
    rows = archive.withColumn("_from", F.lit(0)).unionByName(rolling.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return dedup_first(rows, key, ["_from", *order]).drop("_from")


def hourly_by_symbol(posts: DataFrame, of: str = "sentiment_score") -> DataFrame:
    """symbol, timestamp, sentiment_mean, post_count of every hour from a symbol's first to its last post; hours without
    posts have a mean and a count of 0 and are marked missing."""
    hours = posts.groupBy("symbol", bucket(F.col("timestamp"), 3600).alias("timestamp")).agg(F.avg(of).alias("sentiment_mean"), F.count(F.lit(1)).alias("post_count"))
    rows = hour_grid(hours).join(hours, ["symbol", "timestamp"], "left")
    return rows.withColumn("sentiment_missing", F.isnull("post_count").cast("int")).na.fill(0, ["sentiment_mean", "post_count"])


def archive_stats(df: DataFrame, time: str, group: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_posts"), F.min(F.unix_seconds(time)).alias("first_t"), F.max(F.unix_seconds(time)).alias("last_t"), F.concat_ws(",", F.array_sort(F.collect_set(group))).alias("groups"))


def retain(df: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    return df.where(F.unix_seconds(time) > F.unix_seconds(now) - days * 86400)


def hourly_sentiment(posts: DataFrame, comments: DataFrame, half: float = 5.0) -> DataFrame:
    """Dense hours with means and counts per kind, distinct sources, reliability n / (n + half), shrunk mean, EWMAs, Kalman."""
    both = posts.select("timestamp", "source", "sentiment_score", F.lit(1).alias("_p")).unionByName(comments.select("timestamp", "source", "sentiment_score", F.lit(0).alias("_p")))
    is_post = F.col("_p") == 1
    hours = both.groupBy(bucket(F.col("timestamp"), 3600).alias("timestamp")).agg(
        F.avg(F.when(is_post, F.col("sentiment_score"))).alias("submission_mean"), F.count_if(is_post).alias("submission_count"), F.avg(F.when(~is_post, F.col("sentiment_score"))).alias("comment_mean"), F.count_if(~is_post).alias("comment_count"),
        F.avg("sentiment_score").alias("sentiment_mean"), F.count(F.lit(1)).alias("sentiment_count"), F.countDistinct("source").alias("n_sources"),
    ).withColumn("symbol", F.lit("all"))
    rows = hour_grid(hours).join(hours, ["symbol", "timestamp"], "left")
    rows = rows.withColumn("sentiment_missing", F.isnull("sentiment_count").cast("int")).na.fill(0, ["submission_count", "comment_count", "sentiment_count", "n_sources"])
    rows = rows.withColumn("reliability", F.col("sentiment_count") / (F.col("sentiment_count") + half)).withColumn("_z", F.coalesce("sentiment_mean", F.lit(0.0)))
    rows = rows.withColumn("shrunk_mean", F.col("_z") * F.col("reliability"))
    rows = rows.withColumn("sentiment_lag_1", F.lag("_z").over(ordered())).withColumn("_g", kalman_gain(rows)).withColumn("_first", F.isnull(F.lag("_z").over(ordered())))
    maps = {f"ewma_{n}": (F.when(F.col("_first"), 0.0).otherwise(1 - span_alpha(n)), F.when(F.col("_first"), F.col("_z")).otherwise(span_alpha(n) * F.col("_z"))) for n in (6, 24)}
    rows = affine_scans(rows, {**maps, "kalman": (1 - F.col("_g"), F.col("_g") * F.col("_z"))})
    return rows.withColumn("ewma_diff", F.col("ewma_6") - F.col("ewma_24")).drop("_z", "_g", "_first")


def dynamics(df: DataFrame, of: str = "sentiment") -> DataFrame:
    """Velocity, acceleration, partial-window means and momentum, relative strength of the series."""
    w = ordered()
    rows = df.withColumn("velocity", F.col(of) - F.lag(of).over(w))
    rows = rows.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(w))
    for n in (3, 6, 12, 24):
        rows = rows.withColumn(f"mean_{n}", F.avg(of).over(w.rowsBetween(1 - n, 0))).withColumn(f"momentum_{n}", F.col(of) - F.col(f"mean_{n}"))
    gain, loss = F.when(F.col("velocity") > 0, F.col("velocity")).otherwise(0.0), F.when(F.col("velocity") < 0, -F.col("velocity")).otherwise(0.0)
    rows = rows.withColumn("_g", gain).withColumn("_l", loss)
    frame = w.rowsBetween(-13, 0)
    return rows.withColumn("sentiment_rsi", 100 - 100 / (1 + F.try_divide(F.avg("_g").over(frame), F.avg("_l").over(frame)))).drop("_g", "_l")


def distribution(posts: DataFrame, of: str = "sentiment_score") -> DataFrame:
    """Per hour and symbol, where there are two posts or more: spread, shape, extremes, polarity."""
    x = F.col(of)
    n = F.count(x)
    rows = posts.groupBy("symbol", bucket(F.col("timestamp"), 3600).alias("timestamp")).agg(
        n.alias("n"), F.stddev_samp(x).alias("std"), F.percentile(x, 0.5).alias("median"), F.skewness(x).alias("_s"), F.kurtosis(x).alias("_k"), (F.percentile(x, 0.75) - F.percentile(x, 0.25)).alias("iqr"), F.max(x).alias("max"), F.min(x).alias("min"),
        F.avg((x > 0.5).cast("double")).alias("extreme_up"), F.avg((x < -0.5).cast("double")).alias("extreme_down"), F.avg(((x >= -0.1) & (x <= 0.1)).cast("double")).alias("neutral"), F.abs(F.avg(x)).alias("_m"),
    ).where("n >= 2")
    c = F.col("n")
    skew = F.when((c < 3) | (F.col("std") == 0), 0.0).otherwise(F.col("_s") * F.sqrt(c * (c - 1)) / F.nullif(c - 2, F.lit(0)))
    return rows.withColumn("skew", skew).withColumn("kurtosis", F.when((c < 4) | (F.col("std") == 0), 0.0).otherwise(F.col("_k"))).withColumn("range", F.col("max") - F.col("min")).withColumn("polarity", F.col("_m") / (F.col("std") + 0.01)).withColumn("consensus", 1 - F.least(F.col("std") / 0.5, F.lit(1.0))).drop("_s", "_k", "_m")


def engagement(posts: DataFrame, of: str = "sentiment_score") -> DataFrame:
    """Weighted by log1p(max(score, 0) + 2 * comments) inside an hour, its divergence from the mean, the top fifth's mean."""
    rows = posts.withColumn("e", (F.greatest(F.col("score"), F.lit(0)) + 2 * F.col("num_comments")).cast("double")).withColumn("h", bucket(F.col("timestamp"), 3600))
    top = F.percentile("e", F.lit(0.8)).over(Window.partitionBy("symbol", "h"))
    rows = rows.withColumn("_w", F.log1p("e")).withColumn("_top", top)
    out = rows.groupBy("symbol", F.col("h").alias("timestamp")).agg(
        F.coalesce(F.try_divide(F.sum(F.col("_w") * F.col(of)), F.sum("_w")), F.avg(of)).alias("weighted_mean"), F.avg(F.when(F.col("e") >= F.col("_top"), F.col(of))).alias("high_mean"), F.avg(of).alias("mean"), F.sum("e").alias("total_engagement"), F.max("e").alias("max_engagement"), F.avg("e").alias("mean_engagement"), F.coalesce(F.stddev_samp("e"), F.lit(0.0)).alias("std_engagement")
    )
    return out.withColumn("divergence", F.col("weighted_mean") - F.col("mean"))


def by_source(posts: DataFrame, names: Sequence[str], of: str = "sentiment_score") -> DataFrame:
    """Mean per named source, and agreement: 1 - deviation of the sources' means (1 for one source)."""
    each = posts.groupBy("symbol", bucket(F.col("timestamp"), 3600).alias("timestamp"), F.lower("source").alias("source")).agg(F.avg(of).alias("m"))
    return each.groupBy("symbol", "timestamp").agg(*[F.max(F.when(F.col("source") == n.lower(), F.col("m"))).alias(f"mean_{n.lower()}") for n in names], (1 - F.coalesce(F.stddev_samp("m"), F.lit(0.0))).alias("agreement"))


def level_regime(df: DataFrame, of: str = "sentiment") -> DataFrame:
    x = F.col(of)
    code = F.when(x <= -0.3, -2).when(x <= -0.1, -1).when(x <= 0.1, 0).when(x <= 0.3, 1).when(x.isNotNull(), 2)
    names = {-2: "very_bearish", -1: "bearish", 0: "neutral", 1: "bullish", 2: "very_bullish"}
    return df.withColumn("level_code", code).withColumn("level", F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("level_code")))


def cross_symbol(df: DataFrame, of: str = "sentiment") -> DataFrame:
    """Market mean, deviation and breadth per timestamp, each symbol's relative value and z-score.

    Breadth is the share of all symbols, present at this time or not; the z-score is null where nothing deviates. A
    table with a single symbol is its own market."""
    w = Window.partitionBy("timestamp")
    rows = df.join(df.agg(F.countDistinct("symbol").alias("_all")), how="cross")  # one row
    several, x = F.col("_all") > 1, F.col(of)
    rows = rows.withColumn("market_mean", F.when(several, F.avg(of).over(w)).otherwise(x)).withColumn("market_std", F.when(several, F.stddev_samp(of).over(w)).otherwise(0.0))
    rows = rows.withColumn("market_breadth", F.count_if(x > 0).over(w) / F.col("_all"))
    rows = rows.withColumn("relative", F.when(several, x - F.col("market_mean")).otherwise(0.0))
    return rows.withColumn("zscore", F.when(several, F.try_divide("relative", F.nullif("market_std", F.lit(0.0)))).otherwise(0.0)).drop("_all")


def reversals(df: DataFrame, of: str = "sentiment", back: int = 3, window: int = 6, threshold: float = 0.2) -> DataFrame:
    """1: near the low of its window ``back`` bars ago (up to 1.1 of it) and now higher by more than the threshold;
    -1: near the high (0.9 of it or more) and now lower, which wins; 0 otherwise, and in series shorter than the window."""
    w = ordered()
    x, past = F.col(of), w.rowsBetween(1 - window - back, -back)
    rows = df.withColumns({"_was": F.lag(of, back).over(w), "_lo": F.min(of).over(past), "_hi": F.max(of).over(past), "_l": F.count(F.lit(1)).over(Window.partitionBy("symbol")) >= window})
    down = (F.col("_was") >= F.col("_hi") * 0.9) & (x < F.col("_was") - threshold)
    up = (F.col("_was") <= F.col("_lo") * 1.1) & (x > F.col("_was") + threshold)
    return rows.withColumn("reversal", F.when(F.col("_l") & down, -1).when(F.col("_l") & up, 1).otherwise(0)).drop("_was", "_lo", "_hi", "_l")


def velocity_regime(df: DataFrame, of: str = "velocity") -> DataFrame:
    """-2 to 2 by the right-closed bounds -0.05, -0.01, 0.01, 0.05."""
    x = F.col(of)
    return df.withColumn("velocity_code", F.when(x <= -0.05, -2).when(x <= -0.01, -1).when(x <= 0.01, 0).when(x <= 0.05, 1).when(x.isNotNull(), 2))


def join_sentiment(market: DataFrame, hourly: DataFrame, values: Sequence[str], on: Sequence[str] = ("timestamp",), order: str | None = None) -> DataFrame:
    """market with the sentiment of its hour (and symbol, if ``on`` names it); missing hours get 0 and a flag.

    Of several rows of a key the one with the greatest ``order`` counts (a null order last of all; equal ones, or no
    order: the greatest values, whichever task reads first)."""
    taken = F.max(F.struct(*([F.col(order).alias("_order")] if order else []), F.struct(*values).alias("_v")))
    last = hourly.groupBy(*on).agg(taken.alias("_r")).select(*on, *[F.col("_r._v")[v].alias(v) for v in values])
    rows = market.join(last.withColumn("_there", F.lit(1)), list(on), "left")
    return rows.withColumn("sentiment_join_missing", F.isnull("_there").cast("int")).na.fill(0, list(values)).drop("_there")


def lead_lag(posts: DataFrame, market: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Per symbol of the market: correlation of a post's engagement and sentiment with the return a number of hours later.

    Posts are summed up per hour before they meet the lags, so only hours are multiplied by them."""
    e, s = F.col("score").cast("double"), F.col("sentiment_score")
    sums = [F.count(F.lit(1)).alias("k"), F.sum(e).alias("e"), F.sum(e * e).alias("ee"), F.sum(s).alias("s"), F.sum(s * s).alias("ss")]
    hours = posts.groupBy(F.unix_seconds(bucket(F.col("timestamp"), 3600)).alias("h")).agg(*sums)
    rows = hours.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("_t", F.col("h") + F.col("lag") * 3600)
    bars = market.where("return_1h is not null").select("symbol", F.unix_seconds("timestamp").alias("_t"), F.col("return_1h").alias("r"))
    k, r = F.col("k"), F.col("r")
    found = rows.join(bars, "_t").groupBy("symbol", "lag").agg(
        F.sum(k).alias("n"), F.sum(k * r).alias("r"), F.sum(k * r * r).alias("rr"), F.sum("e").alias("e"), F.sum("ee").alias("ee"), F.sum(F.col("e") * r).alias("er"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * r).alias("sr")
    )

    def corr(x: str) -> Column:
        n, spread = F.col("n"), lambda a, aa: F.col("n") * F.col(aa) - F.col(a) * F.col(a)
        both = spread(x, x + x) * spread("r", "rr")
        return F.when(both > 0, (n * F.col(x + "r") - F.col(x) * F.col("r")) / F.sqrt(both))

    return found.select("symbol", "lag", corr("e").alias("corr_engagement"), corr("s").alias("corr_sentiment"), "n")


def mean_lags(rows: DataFrame) -> DataFrame:
    """Per lag the mean correlations over the symbols, and whether it is the best one by the absolute mean."""
    means = rows.groupBy("lag").agg(F.avg("corr_engagement").alias("corr_engagement"), F.avg("corr_sentiment").alias("corr_sentiment"))
    best = means.agg(*[F.max_by("lag", F.struct(F.abs(c), -F.col("lag"))).alias(f"_{c}") for c in ("corr_engagement", "corr_sentiment")])
    out = means.join(best, how="cross")  # one row
    return out.select("lag", "corr_engagement", "corr_sentiment", *[(F.col("lag") == F.col(f"_{c}")).cast("int").alias(f"best_{c[5:]}") for c in ("corr_engagement", "corr_sentiment")])


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns from one pass of moments."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def content_hash(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A hash of the rows whatever their order: their number and the sum of the rows' SHA-256 in four parts of 64 bits,
    modulo 10**38. Values are quoted with their lengths, so a null is not an empty string and no separator is ambiguous."""
    value = [F.concat(F.coalesce(F.length(F.col(c).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols]
    rows = df.select(F.sha2(F.concat(*value), 256).alias("h"))
    part = lambda k: F.sum(F.conv(F.substring("h", 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"digest_{k}")
    return rows.agg(F.count(F.lit(1)).alias("n"), *[part(k) for k in range(4)])


def post_violations(df: DataFrame, key: str = "id", time: str = "timestamp") -> DataFrame:
    """key, rule: rows with an empty id, without a time, or with an id that stands more than once."""
    for c in (key, time):
        if c not in df.columns:
            raise ValueError(f"the table needs the column {c}")
    empty = F.coalesce(F.trim(F.col(key).cast("string")) == "", F.lit(True))
    own = df.select(F.col(key), F.explode(F.array_compact(F.array(F.when(empty, F.lit("empty_id")), F.when(F.col(time).isNull(), F.lit("missing_time"))))).alias("rule"))
    twice = df.where(~empty).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.lit("duplicate_id").alias("rule"))
    return own.unionByName(twice)


def normalize_posts(df: DataFrame, key: str = "id", time: str = "timestamp") -> DataFrame:
    """Rows with an id and a time, texts without nulls, in the order of time and id."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "selftext", "body", "text") if c in df.columns}
    return df.where(F.coalesce(F.trim(F.col(key).cast("string")) != "", F.lit(False)) & F.col(time).isNotNull()).withColumns(text).orderBy(time, key)


def feature_diagnostics(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows, the share of missing values of each column, the share of rows that met no sentiment, mean reliability and count."""
    extra = {"join_missing_rate": ("sentiment_join_missing", "double"), "mean_reliability": ("reliability", "double"), "mean_count": ("sentiment_count", "double")}
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(F.isnull(c).cast("double")).alias(f"{c}_missing_rate") for c in cols], *[F.avg(F.col(c).cast(k)).alias(n) for n, (c, k) in extra.items() if c in df.columns]
    )
