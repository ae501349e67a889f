"""Queries of sources, studies and cross-series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.shared import new_path
from tidemark.operators import features as X
from tidemark.operators import ledger as L
from tidemark.operators import sketches as SK
from tidemark.operators import study as Y
from tidemark.operators import text as T
from tidemark.operators.candles import CANDLE
from tidemark.plans.base import query, result
from tidemark.plans.market_queries import BARS, RET, VOL, bars
from tidemark.plans.text_queries import POSTS, TAGGED_SQL, comments, posts, scored, tagged
from tidemark.sources import datasets as D
from tidemark.sources import sentiment as DS


@query(f"WITH {BARS} SELECT symbol, t, open, close, volume FROM bars")
def source_klines(spark, sf_dir):
    """Candles as landed JSON arrays, parsed again."""
    b = bars(spark, sf_dir)
    ms = F.unix_seconds("timestamp") * 1000
    landed = b.select("symbol", F.to_json(F.array(*[c.cast("string") for c in (ms, F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume"), ms + 3599999)])).alias("kline"))
    return D.parse_klines(landed).select("symbol", F.unix_seconds("timestamp").alias("t"), "open", "close", "volume")


@query(f"WITH {BARS} SELECT symbol, t FROM bars WHERE t * 1000 + 3599999 <= 1705276800000")
def source_closed_candles(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("close_time", F.timestamp_millis(F.unix_seconds("timestamp") * 1000 + 3599999))
    return result(D.closed_only(b, F.timestamp_seconds(F.lit(1705276800)), F.timestamp_seconds(F.lit(1800000000))), "symbol", "timestamp")


@query(f"WITH {BARS} SELECT symbol, t, close FROM bars WHERE symbol IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) % 2 = 0)")
def source_tradable(spark, sf_dir):
    b = bars(spark, sf_dir)
    info = b.groupBy("symbol").agg(F.sum("volume").cast("long").alias("n")).select("symbol", F.when(F.col("n") % 2 == 0, "TRADING").otherwise("BREAK").alias("status"), F.lit(True).alias("spot_allowed"))
    return D.restrict(b, D.tradable(info)).select("symbol", F.unix_seconds("timestamp").alias("t"), "close")


@query(f"WITH {BARS} SELECT symbol, t FROM bars WHERE t >= 1704499200 AND t <= 1705276800")
def source_load_between(spark, sf_dir):
    return result(D.load_between(bars(spark, sf_dir), "timestamp", F.timestamp_seconds(F.lit(1704499200)), F.timestamp_seconds(F.lit(1705276800))), "symbol", "timestamp")


def _quoted(values: dict[str, str]) -> str:
    """SQL of a row's quoted values by column name, as content_hash quotes them."""
    return " || ".join(f"coalesce(length({v})::VARCHAR, '-') || ':' || coalesce({v}, '')" for _, v in sorted(values.items()))


CANDLE_TEXT = _quoted({"timestamp": "strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')", "symbol": "symbol", **{c: f"{c}::VARCHAR" for c in ("open", "high", "low", "close", "volume")}})


@query(f"WITH {BARS}, h AS (SELECT t, symbol, sha256({CANDLE_TEXT}) AS h FROM bars) SELECT count(*) AS row_count, min(t) AS start, max(t) AS \"end\", count(DISTINCT symbol) AS n_symbols, 'candles.v1' AS schema_version, concat_ws('-', count(*), " + ", ".join(f"sum(('0x' || substr(h, {16 * k + 1}, 16))::UBIGINT)::VARCHAR" for k in range(4)) + ") AS content_hash FROM h")
def source_metadata(spark, sf_dir):
    return D.metadata(bars(spark, sf_dir).select(*CANDLE)).select("row_count", "start", "end", "n_symbols", "schema_version", "content_hash")


@query(f"WITH {POSTS} SELECT doc_id::VARCHAR AS submission_id, t, source AS subreddit, lang AS title, score FROM posts WHERE t BETWEEN 1704499200 AND 1705276800")
def source_sentiment_dataset(spark, sf_dir):
    """Posts and comments written as one dataset by day, checked, and read for nine days of it."""
    p, c = posts(spark, sf_dir), comments(spark, sf_dir)
    subs = p.select(F.col("doc_id").cast("string").alias("submission_id"), F.col("source").alias("subreddit"), F.col("timestamp").alias("created_utc"), F.col("lang").alias("title"), F.col("text").alias("selftext"), "score", "num_comments")
    said = c.select(F.concat_ws("-", "conv_id", "turn").alias("comment_id"), F.col("conv_id").cast("string").alias("submission_id"), F.col("timestamp").alias("created_utc"), F.col("text").alias("body"), F.col("turn").cast("long").alias("depth"))
    path = new_path(spark, "sentiment-dataset")
    DS.write_posts(subs, said, path, "posts", "test")
    rows = DS.read_table(spark, path, "submissions", F.timestamp_seconds(F.lit(1704499200)), F.timestamp_seconds(F.lit(1705276800)), verify=True)
    return rows.select("submission_id", F.unix_seconds("created_utc").alias("t"), "subreddit", "title", "score")


@query(f"WITH {POSTS} SELECT symbol, t // 86400 * 86400 AS t, count(s) AS n, round(avg(s), 6) AS mean, count(DISTINCT source) AS n_sources FROM posts GROUP BY 1, 2")
def sentiment_daily_sketches(spark, sf_dir):
    """Daily means and distinct sources from hourly sketches, without the posts (small counts are exact)."""
    hours = SK.hourly(scored(spark, sf_dir))
    return result(SK.estimates(SK.roll_up(hours)), "symbol", "timestamp", "n", "mean", "n_sources")


@query(f"""WITH {BARS}, {POSTS}, p AS (SELECT {TAGGED_SQL} AS symbol, doc_id, t + doc_id % 3600 AS t, (score + 2 * num_comments)::DOUBLE AS e FROM posts), c AS (SELECT symbol, quantile_cont(e, 0.75) AS cut FROM p GROUP BY 1),
 j AS (SELECT p.*, a.close AS p0, p.t + 21600 AS lt FROM p ASOF LEFT JOIN bars a ON a.symbol = p.symbol AND a.t >= p.t), k AS (SELECT j.*, b.close AS p1 FROM j ASOF LEFT JOIN bars b ON b.symbol = j.symbol AND b.t >= j.lt),
 r AS (SELECT symbol, p1 / p0 - 1 AS r, e >= cut AS h FROM k JOIN c USING (symbol) WHERE p0 IS NOT NULL AND p1 IS NOT NULL),
 s AS (SELECT symbol, count(*) FILTER (h) AS n_high, count(*) FILTER (NOT h) AS n_low, avg(r) FILTER (h) AS mh, avg(r) FILTER (NOT h) AS ml, stddev_pop(r) FILTER (h) AS sh, var_samp(r) FILTER (h) AS vh, var_samp(r) FILTER (NOT h) AS vl, avg((r > 0)::INT) FILTER (h) AS ph FROM r GROUP BY 1),
 t AS (SELECT *, n_high + n_low - 2 AS df, (mh - ml) / sqrt(((n_high - 1) * vh + (n_low - 1) * vl) / (n_high + n_low - 2) * (1 / n_high + 1 / n_low)) AS t FROM s),
 i AS (SELECT symbol, sum(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs(t) * k / 2000, 2) / df, -(df + 1) / 2.0)) * abs(any_value(t)) / 6000 * exp(lgamma((any_value(df) + 1) / 2.0) - lgamma(any_value(df) / 2.0)) / sqrt(any_value(df) * pi()) AS half FROM t, range(0, 2001) g(k) GROUP BY symbol)
 SELECT symbol, n_high, n_low, round(mh, 6) AS mean_high, round(ml, 6) AS mean_low, round(sh, 6) AS std_high, round(ph, 6) AS positive_high, round(t, 6) AS t_statistic, round(1 - 2 * half, 6) AS p_value FROM t JOIN i USING (symbol)""")
def study_engagement_split(spark, sf_dir):
    """Returns after posts of high and of low engagement, per symbol, each post standing for the symbol it is tagged with."""
    p = tagged(spark, sf_dir).select("symbol", F.timestamp_seconds(F.unix_seconds("timestamp") + F.col("doc_id") % 3600).alias("timestamp"), (F.col("score") + 2 * F.col("num_comments")).cast("double").alias("engagement"))
    return result(Y.engagement_split(p, bars(spark, sf_dir), 6), "symbol", "n_high", "n_low", "mean_high", "mean_low", "std_high", "positive_high", "t_statistic", "p_value")


INFLATED = ["return_1h", "return_3h", "realized_volatility_24h", "high_low_range_1h"]


def _inverse_sql(source: str, cols: list[str]) -> tuple[str, str]:
    """SQL of the rows and of the table inv: the diagonal of the inverse correlation matrix, by Gauss-Jordan elimination on lists."""
    k = len(cols)
    rows = ", ".join("[" + ", ".join([("1.0" if a == b else f"corr({a}, {b})") for b in cols] + [str(float(a == b)) for b in cols]) + "]" for a in cols)
    m = f"(SELECT [{rows}] AS m FROM {source})"
    for j in range(1, k + 1):
        m = f"(SELECT list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = {j} THEN list_transform(m[{j}], lambda v: v / m[{j}][{j}]) ELSE list_transform(range(1, {2 * k + 1}), lambda c: m[i][c] - m[i][{j}] / m[{j}][{j}] * m[{j}][c]) END) AS m FROM {m})"
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, round(m[{i}][{k + i}], 6) AS vif FROM inv" for i, c in enumerate(cols, 1)), m


@query(f"WITH {BARS}, {RET}, {VOL}, x AS (SELECT return_1h, return_3h, realized_volatility_24h, (high - low) / close AS high_low_range_1h FROM vol), f AS (SELECT * FROM x WHERE return_1h IS NOT NULL AND return_3h IS NOT NULL AND realized_volatility_24h IS NOT NULL AND high_low_range_1h IS NOT NULL), inv AS (SELECT * FROM {_inverse_sql('f', INFLATED)[1]}) {_inverse_sql('f', INFLATED)[0]}")
def study_variance_inflation(spark, sf_dir):
    rows = X.range_pct(X.realized_vol(X.returns(bars(spark, sf_dir), [1, 3])))
    return result(Y.variance_inflation(rows, INFLATED))


PRICES = ["open", "high", "low", "close", "volume"]


@query(f"WITH {BARS}, c AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM bars" for i, a in enumerate(PRICES) for b in PRICES[i + 1 :])}) SELECT a, b, round(r, 6) AS r FROM c WHERE abs(r) > 0.1")
def study_collinear_pairs(spark, sf_dir):
    return result(Y.collinear_pairs(T.correlation_pairs(bars(spark, sf_dir), PRICES), 0.1))


@query(f"WITH {BARS}, d AS (SELECT symbol, t, (t // 3600) % 24 AS h, (DATE '1970-01-01' + (t // 86400)::INT) AS d FROM bars) SELECT symbol, t, CASE WHEN h < 8 THEN 'asia' WHEN h < 16 THEN 'europe' ELSE 'america' END AS session, (last_day(d) - d)::INT AS days_to_month_end, ((last_day(d) - d) <= 2)::INT AS month_end FROM d")
def feature_sessions(spark, sf_dir):
    return result(Y.sessions(bars(spark, sf_dir)), "symbol", "timestamp", "session", "days_to_month_end", "month_end")


@query(f"WITH {BARS}, {RET}, {VOL} SELECT symbol, t, round(realized_volatility_24h / avg(realized_volatility_24h) OVER (PARTITION BY symbol, (t // 3600) % 24 ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS vol_vs_hour FROM vol")
def feature_hour_of_day_volatility(spark, sf_dir):
    return result(Y.hour_of_day_volatility(X.realized_vol(X.returns(bars(spark, sf_dir), [1])), "realized_volatility_24h"), "symbol", "timestamp", "vol_vs_hour")


@query(f"""WITH {BARS}, {RET}, s AS (SELECT CASE WHEN symbol IN ('click', 'view') THEN 'browse' ELSE 'act' END AS symbol, t, avg(return_1h) AS sr, count(*) AS n FROM ret WHERE return_1h IS NOT NULL GROUP BY 1, 2)
 SELECT symbol, t, round(sr, 6) AS sector_return, n AS n_symbols, round(CASE WHEN count(sr) OVER x = 6 THEN avg(sr) OVER x END, 6) AS sector_momentum FROM s WINDOW x AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def feature_sector_momentum(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("sector", F.when(F.col("symbol").isin("click", "view"), "browse").otherwise("act"))
    return result(Y.sector_momentum(b, "sector"), "symbol", "timestamp", "sector_return", "n_symbols", "sector_momentum")


@query(f"WITH {BARS}, {RET} SELECT t, round(max(return_1h) FILTER (symbol = 'click') - avg(return_1h) FILTER (symbol != 'click'), 6) AS reference_spread FROM ret GROUP BY t")
def feature_reference_spread(spark, sf_dir):
    return result(Y.reference_spread(bars(spark, sf_dir), "click"), "timestamp", "reference_spread")


@query(f"WITH {BARS}, f AS (SELECT symbol, t AS ft, open AS rate FROM bars WHERE (t // 3600) % 8 = 0) SELECT b.symbol, b.t, f.rate FROM bars b ASOF LEFT JOIN f ON f.symbol = b.symbol AND f.ft <= b.t")
def feature_carry_forward(spark, sf_dir):
    b = bars(spark, sf_dir)
    rates = b.where(F.floor(F.unix_seconds("timestamp") / 3600) % 8 == 0).select("symbol", "timestamp", F.col("open").alias("rate"))
    return Y.carry_forward(b.select("symbol", "timestamp"), rates, "rate").select("symbol", F.unix_seconds("timestamp").alias("t"), "rate")


CORR = "cr AS (SELECT a.symbol, count(*) AS n_pairs, CASE WHEN a.symbol = 'click' THEN 1.0 WHEN count(*) >= 30 THEN coalesce(corr(a.return_1h, b.return_1h), 0.9) ELSE 0.9 END AS correlation FROM ret a JOIN ret b ON b.t = a.t AND b.symbol = 'click' WHERE a.return_1h IS NOT NULL AND b.return_1h IS NOT NULL GROUP BY a.symbol)"


@query(f"WITH {BARS}, {RET}, {CORR} SELECT symbol, n_pairs, round(correlation, 6) AS correlation FROM cr")
def risk_reference_correlation(spark, sf_dir):
    return result(Y.reference_correlation(bars(spark, sf_dir), "click"))


@query(f"WITH {BARS}, {RET}, {CORR}, v AS (SELECT symbol, sum(volume * close) AS value FROM bars GROUP BY 1) SELECT round(sum(value * correlation), 4) AS correlated_exposure, round(sum(value), 4) AS exposure FROM v JOIN cr USING (symbol)")
def risk_correlated_exposure(spark, sf_dir):
    b = bars(spark, sf_dir)
    held = b.withColumns({"quantity": F.col("volume"), "price": F.col("close"), "entry_price": F.col("close")})
    got = Y.correlated_exposure(L.portfolio_snapshot(held, ["symbol"]).select("symbol", "value"), Y.reference_correlation(b, "click"))
    return got.select(*[F.round(c, 4).alias(c) for c in got.columns])


@query(f"""WITH {BARS}, {RET}, {CORR}, h AS (SELECT symbol, CASE WHEN symbol = 'click' THEN 'browse' ELSE 'act' END AS sector, sum(volume) AS value FROM bars WHERE symbol < 'p' GROUP BY 1), c AS (SELECT symbol, t, CASE WHEN symbol IN ('click', 'view') THEN 'browse' ELSE 'act' END AS sector, (t // 3600 % 50)::DOUBLE * 100 AS size FROM bars),
 a AS (SELECT count(*) AS n, coalesce(sum(value), 0) AS v, coalesce(sum(value * coalesce(correlation, 0.9)), 0) AS wv FROM h LEFT JOIN cr USING (symbol)), s AS (SELECT sector, sum(value) AS sv FROM h GROUP BY 1)
 SELECT c.symbol, c.t, CASE WHEN n >= 5 THEN 'positions' WHEN h.symbol IS NOT NULL THEN 'duplicate' WHEN (v + size) / (v + 10000) > 0.4 THEN 'exposure' WHEN size / (v + 10000) > 0.3 THEN 'single' WHEN (coalesce(sv, 0) + size) / (v + 10000) > 0.25 THEN 'sector' WHEN c.symbol != 'click' AND (wv + size * coalesce(correlation, 0.9)) / (v + 10000) > 0.08 THEN 'correlated' END AS rejected_by
 FROM c CROSS JOIN a LEFT JOIN h ON h.symbol = c.symbol LEFT JOIN s ON s.sector = c.sector LEFT JOIN cr ON cr.symbol = c.symbol""")
def risk_entry_checks(spark, sf_dir):
    b = bars(spark, sf_dir)
    held = b.where("symbol < 'p'").withColumn("sector", F.when(F.col("symbol") == "click", "browse").otherwise("act")).groupBy("symbol", "sector").agg(F.sum("volume").alias("value"))
    c = b.select("symbol", "timestamp", F.when(F.col("symbol").isin("click", "view"), "browse").otherwise("act").alias("sector"), (F.floor(F.unix_seconds("timestamp") / 3600) % 50 * 100.0).alias("size"))
    known = Y.reference_correlation(b, "click").select("symbol", "correlation")
    return result(L.check_entries(c, held, known, 10_000.0, "click", 5, 0.3, 0.4, 0.25, 0.08), "symbol", "timestamp", "rejected_by")
