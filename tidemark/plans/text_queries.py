"""Posts, sentiment, joins with the market, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import as_of
from tidemark.operators import features as X
from tidemark.operators import technical as K
from tidemark.operators import text as T
from tidemark.plans.market_queries import BARS, RET, W, bars, exp_mean
from tidemark.plans.base import query, result

UP, DOWN = ["the", "and", "la", "die"], ["of", "to", "de", "der"]
START = 1704067200  # 2024-01-01
KEYWORDS = {"AAA": ["the", "in"], "BBB": ["and", "with"], "CCC": ["de", "der"]}


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts: one symbol, times from doc_id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", "text", "source", "lang", F.timestamp_seconds(F.lit(START) + F.col("doc_id") % 720 * 3600).alias("timestamp"), (F.col("doc_id") % 100).alias("score"), (F.col("doc_id") % 50).alias("num_comments"), F.upper("lang").alias("symbol"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", "text", F.col("role").alias("source"), F.timestamp_seconds(F.lit(START) + F.col("conv_id") % 720 * 3600 + F.col("turn") * 60).alias("timestamp"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lexicon_score(posts(spark, sf_dir), "text", UP, DOWN)


def _count(words: list[str]) -> str:
    return f"len(list_filter(ws, lambda x: x IN ({', '.join(map(repr, words))})))"


def _scores(table: str) -> str:
    words = r"""list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: trim(x, '.,!?;:()[]{}"''')) AS ws"""
    return f"(SELECT *, CASE WHEN u + d = 0 THEN 0.0 ELSE (u - d)::DOUBLE / (u + d) END AS s FROM (SELECT *, {_count(UP)} AS u, {_count(DOWN)} AS d FROM (SELECT *, {words} FROM {table})))"


POSTS = f"posts AS (SELECT doc_id, text, source, lang, upper(lang) AS symbol, {START} + doc_id % 720 * 3600 AS t, doc_id % 100 AS score, doc_id % 50 AS num_comments, s FROM {_scores('documents')})"
COMMENTS = f"comments AS (SELECT conv_id, role AS source, {START} + conv_id % 720 * 3600 + turn * 60 AS t, s FROM {_scores('conversations')})"


@query(f"WITH {POSTS} SELECT doc_id, round(s, 6) AS sentiment_score FROM posts")
def text_lexicon_scores(spark, sf_dir):
    return result(scored(spark, sf_dir), "doc_id", "sentiment_score")


@query(f"WITH {POSTS} SELECT doc_id, round(s, 6) AS sentiment_score FROM posts")
def text_score_distinct(spark, sf_dir):
    return result(T.score_distinct(posts(spark, sf_dir), "text", UP, DOWN), "doc_id", "sentiment_score")


LISTED = "lex AS (SELECT word, CASE WHEN length(word) % 2 = 0 THEN 1.0 ELSE -1.0 END AS weight FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark))"
LISTED_WORDS = r"""lw AS (SELECT doc_id, trim(w, '.,!?;:()[]{}"''') AS word FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\s+')) AS w FROM documents))"""


@query(f"WITH {LISTED}, {LISTED_WORDS}, s AS (SELECT doc_id, sum(weight) / count(*) AS s FROM lw JOIN lex USING (word) GROUP BY 1) SELECT doc_id, round(coalesce(s, 0), 6) AS sentiment_score FROM documents LEFT JOIN s USING (doc_id)")
def text_lexicon_table(spark, sf_dir):
    """Scores by a lexicon that is a table, of any size: all words of the benchmark's items, even lengths positive."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = items.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    lexicon = words.withColumn("weight", F.when(F.length("word") % 2 == 0, 1.0).otherwise(-1.0))
    return result(T.lexicon_scores(posts(spark, sf_dir), "doc_id", "text", lexicon), "doc_id", "sentiment_score")


@query(r"""WITH p AS (SELECT DISTINCT 'I' || (item_id % 7) AS symbol, x[1:2] AS p FROM (SELECT item_id, regexp_extract_all(lower(text), '[0-9A-Za-z_]+') AS x FROM benchmark)), t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z_]+') AS x FROM documents),
 h AS (SELECT DISTINCT doc_id, x[i:i+1] AS two FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM t)) SELECT DISTINCT doc_id, symbol FROM h JOIN p ON p.p = h.two""")
def text_tag_patterns(spark, sf_dir):
    """Documents that hold the first two words of a benchmark item, the items being a table of patterns."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), 0)
    patterns = items.select(F.concat(F.lit("I"), F.col("item_id") % 7).alias("symbol"), F.array_join(F.slice(words, 1, 2), " ").alias("pattern"))
    return T.tag_by_patterns(posts(spark, sf_dir), "doc_id", "text", patterns)


@query("SELECT doc_id, md5(trim(coalesce(source, '') || chr(10) || coalesce(text, ''))) AS digest FROM documents")
def text_post_text(spark, sf_dir):
    return T.post_text(posts(spark, sf_dir), "source", "text").select("doc_id", F.md5(F.col("post_text").cast("binary")).alias("digest"))


@query("SELECT doc_id, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^\\w])({'|'.join(w)})($|[^\\w])') THEN '{s}' END" for s, w in KEYWORDS.items()) + "], lambda x: x IS NOT NULL)) AS symbol FROM documents")
def text_tag_symbols(spark, sf_dir):
    return T.tag_symbols(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", KEYWORDS).select("doc_id", "symbol")


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def posts_dedup_first(spark, sf_dir):
    return T.dedup_first(posts(spark, sf_dir), "source", ["doc_id"]).select("source", "doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM documents WHERE lang != 'en' OR lang IS NULL")
def posts_append_new(spark, sf_dir):
    p = posts(spark, sf_dir).select("doc_id", "lang")
    return T.append_new(p.where("lang = 'en'"), p, "doc_id", ["lang"]).select("doc_id")


@query(f"WITH {POSTS} SELECT count(*) AS n_posts, min(t) AS first_t, max(t) AS last_t, array_to_string(list_sort(list(DISTINCT source)), ',') AS groups FROM posts")
def posts_archive_stats(spark, sf_dir):
    return T.archive_stats(posts(spark, sf_dir), "timestamp", "source")


@query(f"WITH {POSTS} SELECT doc_id FROM posts WHERE t > {START} + 29 * 86400 - 7 * 86400")
def posts_retain(spark, sf_dir):
    return T.retain(posts(spark, sf_dir), "timestamp", F.timestamp_seconds(F.lit(START + 29 * 86400)), 7).select("doc_id")


HOURLY = f"""both_ AS (SELECT t // 3600 * 3600 AS t, source, s, 1 AS p FROM posts UNION ALL SELECT t // 3600 * 3600, source, s, 0 FROM comments), hours AS (SELECT t, avg(s) FILTER (p = 1) AS submission_mean, count(*) FILTER (p = 1) AS submission_count,
 avg(s) FILTER (p = 0) AS comment_mean, count(*) FILTER (p = 0) AS comment_count, avg(s) AS sentiment_mean, count(*) AS sentiment_count, count(DISTINCT source) AS n_sources FROM both_ GROUP BY 1),
 g AS (SELECT 'all' AS symbol, unnest(range(min(t), max(t) + 3600, 3600)) AS t FROM hours), h AS (SELECT g.symbol, g.t, coalesce(hours.sentiment_mean, 0) AS z, hours.* EXCLUDE (t) FROM g LEFT JOIN hours ON hours.t = g.t)"""


@query(f"""WITH {POSTS}, {COMMENTS}, {HOURLY} SELECT t, round(submission_mean, 6) AS submission_mean, coalesce(submission_count, 0) AS submission_count, round(comment_mean, 6) AS comment_mean, coalesce(comment_count, 0) AS comment_count, round(sentiment_mean, 6) AS sentiment_mean,
 coalesce(sentiment_count, 0) AS sentiment_count, coalesce(n_sources, 0) AS n_sources, (sentiment_count IS NULL)::INT AS sentiment_missing, round(z * coalesce(sentiment_count, 0) / (coalesce(sentiment_count, 0) + 5), 6) AS shrunk_mean,
 round({exp_mean('z', 2 / 7)}, 6) AS ewma_6, round({exp_mean('z', 2 / 25)}, 6) AS ewma_24, round(lag(z) OVER w, 6) AS sentiment_lag_1 FROM h {W}""")
def sentiment_hourly(spark, sf_dir):
    c = T.lexicon_score(comments(spark, sf_dir), "text", UP, DOWN)
    rows = T.hourly_sentiment(scored(spark, sf_dir), c)
    return result(rows, "timestamp", "submission_mean", "submission_count", "comment_mean", "comment_count", "sentiment_mean", "sentiment_count", "n_sources", "sentiment_missing", "shrunk_mean", "ewma_6", "ewma_24", "sentiment_lag_1")


@query(f"""WITH RECURSIVE {BARS}, p AS (SELECT symbol, t, close, row_number() OVER w AS k FROM bars {W}), f AS (SELECT symbol, t, k, 1.01 / 1.26 * close AS y, 1.01 * (1 - 1.01 / 1.26) AS v FROM p WHERE k = 1
 UNION ALL SELECT p.symbol, p.t, p.k, f.y + (f.v + 0.01) / (f.v + 0.26) * (p.close - f.y), (1 - (f.v + 0.01) / (f.v + 0.26)) * (f.v + 0.01) FROM f JOIN p ON p.symbol = f.symbol AND p.k = f.k + 1) SELECT symbol, t, round(y, 6) AS kalman FROM f""")
def sentiment_kalman(spark, sf_dir):
    from tidemark.functions.windows import kalman

    return result(kalman(bars(spark, sf_dir), F.col("close"), "kalman"), "symbol", "timestamp", "kalman")


SERIES = f"ser AS (SELECT symbol, t, avg(s) AS sentiment FROM (SELECT symbol, t // 3600 * 3600 AS t, s FROM posts) GROUP BY 1, 2)"  # noqa: F541


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("symbol", F.date_trunc("hour", "timestamp").alias("timestamp")).agg(F.avg("sentiment_score").alias("sentiment"))


@query(f"""WITH {POSTS}, {SERIES}, v AS (SELECT *, sentiment - lag(sentiment) OVER w AS v FROM ser {W}), g AS (SELECT *, CASE WHEN v > 0 THEN v ELSE 0 END AS g, CASE WHEN v < 0 THEN -v ELSE 0 END AS l FROM v)
 SELECT symbol, t, round(v, 6) AS velocity, round(v - lag(v) OVER w, 6) AS acceleration, {', '.join(f"round(avg(sentiment) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS mean_{n}, round(sentiment - avg(sentiment) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS momentum_{n}" for n in (3, 6, 12, 24))},
 round(100 - 100 / (1 + avg(g) OVER x / nullif(avg(l) OVER x, 0)), 4) AS sentiment_rsi FROM g WINDOW w AS (PARTITION BY symbol ORDER BY t), x AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def sentiment_dynamics(spark, sf_dir):
    rows = T.dynamics(_series(spark, sf_dir)).withColumn("sentiment_rsi", F.round("sentiment_rsi", 4))
    return result(rows, "symbol", "timestamp", "velocity", "acceleration", *[f"{k}_{n}" for n in (3, 6, 12, 24) for k in ("mean", "momentum")], "sentiment_rsi")


@query(f"WITH {POSTS}, {SERIES}, m AS (SELECT symbol, t, ({exp_mean('sentiment', 2 / 13)}) - ({exp_mean('sentiment', 2 / 27)}) AS macd FROM ser {W}), s AS (SELECT *, {exp_mean('macd', 0.2)} AS sig FROM m {W}) SELECT symbol, t, round(macd, 6) + 0.0 AS sentiment_macd, round(sig, 6) + 0.0 AS sentiment_macd_signal, round(macd - sig, 6) + 0.0 AS sentiment_macd_histogram FROM s")
def sentiment_macd(spark, sf_dir):
    """The difference of two exponential means of a symbol's sentiment, and its own mean."""
    cols = ["sentiment_macd", "sentiment_macd_signal", "sentiment_macd_histogram"]
    rows = result(K.macd(_series(spark, sf_dir), of="sentiment", prefix="sentiment_macd"), "symbol", "timestamp", *cols)
    return rows.withColumns({c: F.col(c) + 0.0 for c in cols})


@query(f"""WITH {POSTS}, d AS (SELECT symbol, t // 3600 * 3600 AS t, count(*) AS n, stddev_samp(s) AS sd, median(s) AS m, quantile_cont(s, 0.75) - quantile_cont(s, 0.25) AS iqr, max(s) AS mx, min(s) AS mn, avg((s > 0.5)::INT) AS eu, avg((s >= -0.1 AND s <= 0.1)::INT) AS ne, abs(avg(s)) / (stddev_samp(s) + 0.01) AS po FROM posts GROUP BY 1, 2)
 SELECT symbol, t, n, round(sd, 6) AS std, round(m, 6) AS median, round(iqr, 6) AS iqr, round(mx - mn, 6) AS range, round(eu, 6) AS extreme_up, round(ne, 6) AS neutral, round(po, 6) AS polarity, round(1 - least(sd / 0.5, 1), 6) AS consensus FROM d WHERE n >= 2""")
def sentiment_distribution(spark, sf_dir):
    return result(T.distribution(scored(spark, sf_dir)), "symbol", "timestamp", "n", "std", "median", "iqr", "range", "extreme_up", "neutral", "polarity", "consensus")


@query(f"""WITH {POSTS}, e AS (SELECT symbol, t // 3600 * 3600 AS t, s, (greatest(score, 0) + 2 * num_comments)::DOUBLE AS e FROM posts), q AS (SELECT *, quantile_cont(e, 0.8) OVER (PARTITION BY symbol, t) AS top FROM e),
 a AS (SELECT symbol, t, coalesce(sum(ln(1 + e) * s) / nullif(sum(ln(1 + e)), 0), avg(s)) AS w, avg(s) FILTER (e >= top) AS h, avg(s) AS m, sum(e) AS te, max(e) AS me, avg(e) AS ae, coalesce(stddev_samp(e), 0) AS se FROM q GROUP BY 1, 2)
 SELECT symbol, t, round(w, 6) AS weighted_mean, round(h, 6) AS high_mean, round(w - m, 6) + 0.0 AS divergence, te AS total_engagement, me AS max_engagement, round(ae, 6) AS mean_engagement, round(se, 6) AS std_engagement FROM a""")
def sentiment_engagement(spark, sf_dir):
    return result(T.engagement(scored(spark, sf_dir)), "symbol", "timestamp", "weighted_mean", "high_mean", "divergence", "total_engagement", "max_engagement", "mean_engagement", "std_engagement").withColumn("divergence", F.col("divergence") + 0.0)


@query(f"""WITH {POSTS}, e AS (SELECT symbol, t // 3600 * 3600 AS t, lower(source) AS source, avg(s) AS m FROM posts GROUP BY 1, 2, 3) SELECT symbol, t, round(max(m) FILTER (source = 'src0'), 6) AS mean_src0, round(max(m) FILTER (source = 'src1'), 6) AS mean_src1, round(1 - coalesce(stddev_samp(m), 0), 6) AS agreement FROM e GROUP BY 1, 2""")
def sentiment_by_source(spark, sf_dir):
    return result(T.by_source(scored(spark, sf_dir), ["src0", "SRC1"]), "symbol", "timestamp", "mean_src0", "mean_src1", "agreement")


@query(f"""WITH {POSTS}, {SERIES} SELECT symbol, t, CASE WHEN sentiment <= -0.3 THEN 'very_bearish' WHEN sentiment <= -0.1 THEN 'bearish' WHEN sentiment <= 0.1 THEN 'neutral' WHEN sentiment <= 0.3 THEN 'bullish' ELSE 'very_bullish' END AS level FROM ser""")
def sentiment_level_regime(spark, sf_dir):
    return result(T.level_regime(_series(spark, sf_dir)), "symbol", "timestamp", "level")


@query(f"""WITH {POSTS}, {SERIES}, c AS (SELECT *, avg(sentiment) OVER x AS m, stddev_samp(sentiment) OVER x AS sd, (count(*) FILTER (sentiment > 0) OVER x) / (SELECT count(DISTINCT symbol) FROM ser) AS b FROM ser WINDOW x AS (PARTITION BY t))
 SELECT symbol, t, round(m, 6) AS market_mean, round(sd, 6) AS market_std, round(b, 6) AS market_breadth, round(sentiment - m, 6) + 0.0 AS relative, round((sentiment - m) / nullif(sd, 0), 5) + 0.0 AS zscore FROM c""")
def sentiment_cross_symbol(spark, sf_dir):
    rows = T.cross_symbol(_series(spark, sf_dir)).withColumn("zscore", F.round("zscore", 5))
    rows = result(rows, "symbol", "timestamp", "market_mean", "market_std", "market_breadth", "relative", "zscore")
    return rows.withColumn("relative", F.col("relative") + 0.0).withColumn("zscore", F.col("zscore") + 0.0)


@query(f"""WITH {BARS}, {POSTS}, a AS (SELECT t // 3600 * 3600 AS t, avg(s) AS m, count(*) AS n FROM posts GROUP BY 1) SELECT b.symbol, b.t, round(coalesce(m, 0), 6) AS sentiment_mean, coalesce(n, 0) AS sentiment_count, (a.t IS NULL)::INT AS sentiment_join_missing FROM bars b LEFT JOIN a ON a.t = b.t""")
def join_market_sentiment(spark, sf_dir):
    h = scored(spark, sf_dir).groupBy(F.date_trunc("hour", "timestamp").alias("timestamp")).agg(F.avg("sentiment_score").alias("sentiment_mean"), F.count(F.lit(1)).alias("sentiment_count"))
    return result(T.join_sentiment(bars(spark, sf_dir), h, ["sentiment_mean", "sentiment_count"]), "symbol", "timestamp", "sentiment_mean", "sentiment_count", "sentiment_join_missing")


#: The market symbol that a post is about.
MARKET = ["click", "error", "purchase", "signup", "view"]
TAGGED_SQL = f"({MARKET}::VARCHAR[])[doc_id % 5 + 1]"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the market symbol that they are about."""
    return posts(spark, sf_dir).withColumn("symbol", F.get(F.array(*map(F.lit, MARKET)), (F.col("doc_id") % 5).cast("int")))


@query(f"WITH {BARS}, {POSTS}, s AS (SELECT DISTINCT symbol FROM bars), p AS (SELECT doc_id, s.symbol, t + doc_id % 3600 AS pt FROM posts, s) SELECT p.doc_id, p.symbol, bars.t AS bar_t, round(close, 6) AS close FROM p ASOF LEFT JOIN bars ON p.symbol = bars.symbol AND bars.t >= p.pt")
def join_as_of_forward(spark, sf_dir):
    """Each post with the next bar of every symbol: the bars are found once for each time that posts have."""
    market = bars(spark, sf_dir).select("symbol", "timestamp", F.unix_seconds("timestamp").alias("bar_t"), "close")
    p = posts(spark, sf_dir).select("doc_id", F.timestamp_seconds(F.unix_seconds("timestamp") + F.col("doc_id") % 3600).alias("at"))
    times = p.select("at").distinct().join(market.select("symbol").distinct(), how="cross")
    found = as_of(times, market, ["symbol"], F.col("at"), F.col("timestamp"), ["bar_t", "close"], forward=True).withColumnRenamed("at", "_at")
    return result(p.join(found, F.col("at").eqNullSafe(F.col("_at"))), "doc_id", "symbol", "bar_t", "close")


LAG_SQL = f"""{RET}, {POSTS}, l AS (SELECT unnest(range(1, 25)) AS lag), j AS (SELECT r.symbol, l.lag, p.score, p.s, r.return_1h AS r FROM posts p CROSS JOIN l JOIN ret r ON r.t = p.t // 3600 * 3600 + l.lag * 3600 WHERE r.return_1h IS NOT NULL),
 c AS (SELECT symbol, lag::INT AS lag, corr(score, r) AS ce, corr(s, r) AS cs, count(*) AS n FROM j GROUP BY 1, 2)"""


@query(f"WITH {BARS}, {LAG_SQL} SELECT symbol, lag, round(ce, 5) AS corr_engagement, round(cs, 5) AS corr_sentiment, n FROM c")
def study_lead_lag(spark, sf_dir):
    rows = T.lead_lag(scored(spark, sf_dir), X.returns(bars(spark, sf_dir), [1]), list(range(1, 25)))
    return rows.select("symbol", "lag", F.round("corr_engagement", 5).alias("corr_engagement"), F.round("corr_sentiment", 5).alias("corr_sentiment"), "n")


@query(f"""WITH {BARS}, {LAG_SQL}, m AS (SELECT lag, avg(ce) AS ce, avg(cs) AS cs FROM c GROUP BY lag) SELECT lag, round(ce, 5) AS corr_engagement, round(cs, 5) AS corr_sentiment,
 (row_number() OVER (ORDER BY abs(ce) DESC, lag) = 1)::INT AS best_engagement, (row_number() OVER (ORDER BY abs(cs) DESC, lag) = 1)::INT AS best_sentiment FROM m""")
def study_best_lag(spark, sf_dir):
    rows = T.mean_lags(T.lead_lag(scored(spark, sf_dir), X.returns(bars(spark, sf_dir), [1]), list(range(1, 25))))
    return rows.withColumns({c: F.round(c, 5) for c in ("corr_engagement", "corr_sentiment")})


@query(f"""WITH {POSTS}, {SERIES}, r AS (SELECT *, count(*) OVER (PARTITION BY symbol) >= 6 AS long, lag(sentiment, 3) OVER w AS e, min(sentiment) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS lo, max(sentiment) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS hi, sentiment - lag(sentiment) OVER w AS v FROM ser {W})
 SELECT symbol, t, CASE WHEN long AND e >= hi * 0.9::DOUBLE AND sentiment < e - 0.2::DOUBLE THEN -1 WHEN long AND e <= lo * 1.1::DOUBLE AND sentiment > e + 0.2::DOUBLE THEN 1 ELSE 0 END AS reversal, CASE WHEN v <= -0.05 THEN -2 WHEN v <= -0.01 THEN -1 WHEN v <= 0.01 THEN 0 WHEN v <= 0.05 THEN 1 WHEN v IS NOT NULL THEN 2 END AS velocity_code FROM r""")
def sentiment_reversals(spark, sf_dir):
    return result(T.velocity_regime(T.dynamics(T.reversals(_series(spark, sf_dir)))), "symbol", "timestamp", "reversal", "velocity_code")


@query(f"WITH {BARS}, c AS (SELECT corr(open, close) AS oc, corr(open, volume) AS ov, corr(close, volume) AS cv FROM bars) SELECT 'open' AS a, 'close' AS b, round(oc, 6) AS r FROM c UNION ALL SELECT 'open', 'volume', round(ov, 6) FROM c UNION ALL SELECT 'close', 'volume', round(cv, 6) FROM c")
def study_correlations(spark, sf_dir):
    return result(T.correlation_pairs(bars(spark, sf_dir), ["open", "close", "volume"]), "a", "b", "r")


HASHED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
QUOTED = " || ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR, '-') || ':' || coalesce({c}::VARCHAR, '')" for c in HASHED)


@query(f"WITH h AS (SELECT sha256({QUOTED}) AS h FROM orders) SELECT count(*) AS n, " + ", ".join(f"sum(('0x' || substr(h, {16 * k + 1}, 16))::UBIGINT)::VARCHAR AS digest_{k}" for k in range(4)) + " FROM h")
def dataset_content_hash(spark, sf_dir):
    return T.content_hash(spark.read.parquet(f"{sf_dir}/orders.parquet"), HASHED)


@query("""WITH d AS (SELECT CASE WHEN doc_id % 50 = 0 THEN ' ' ELSE (doc_id // 3)::VARCHAR END AS id, CASE WHEN doc_id % 40 = 1 THEN NULL ELSE doc_id END AS t FROM documents)
 SELECT id, 'empty_id' AS rule FROM d WHERE trim(id) = '' UNION ALL SELECT id, 'missing_time' FROM d WHERE t IS NULL UNION ALL SELECT id, 'duplicate_id' FROM d WHERE trim(id) != '' GROUP BY id HAVING count(*) > 1""")
def posts_violations(spark, sf_dir):
    """Posts with some ids taken away or made equal and some times missing."""
    i = F.col("doc_id")
    rows = posts(spark, sf_dir).select(F.when(i % 50 == 0, " ").otherwise(F.floor(i / 3).cast("string")).alias("id"), F.when(i % 40 != 1, F.col("timestamp")).alias("timestamp"))
    return T.post_violations(rows)


@query(f"WITH {BARS}, {RET}, {POSTS}, a AS (SELECT t // 3600 * 3600 AS t, count(*) AS n FROM posts GROUP BY 1) SELECT b.symbol, count(*) AS n_rows, round(avg((return_1h IS NULL)::INT), 6) AS return_1h_missing_rate, round(avg((return_72h IS NULL)::INT), 6) AS return_72h_missing_rate, round(avg((a.t IS NULL)::INT), 6) AS join_missing_rate, round(avg(coalesce(n, 0) / (coalesce(n, 0) + 5)), 6) AS mean_reliability, round(avg(coalesce(n, 0)), 6) AS mean_count FROM ret b LEFT JOIN a ON a.t = b.t GROUP BY 1")
def sentiment_feature_diagnostics(spark, sf_dir):
    h = posts(spark, sf_dir).groupBy(F.date_trunc("hour", "timestamp").alias("timestamp")).agg(F.count(F.lit(1)).alias("sentiment_count"))
    rows = T.join_sentiment(X.returns(bars(spark, sf_dir)), h, ["sentiment_count"]).withColumn("reliability", F.col("sentiment_count") / (F.col("sentiment_count") + 5))
    return result(T.feature_diagnostics(rows, ["return_1h", "return_72h"]))


@query(f"WITH {BARS}, {RET} SELECT symbol, count(*) AS n, min(t) AS first_t FROM ret WHERE return_1h IS NOT NULL AND return_72h IS NOT NULL GROUP BY 1")
def feature_complete_cases(spark, sf_dir):
    rows = X.complete_cases(X.returns(bars(spark, sf_dir)), ["return_1h", "return_72h"])
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_seconds("timestamp")).alias("first_t"))


@query(f"WITH {POSTS}, h AS (SELECT symbol, t // 3600 * 3600 AS t, avg(s) AS m, count(*) AS n FROM posts GROUP BY 1, 2), g AS (SELECT symbol, unnest(range(min(t), max(t) + 3600, 3600)) AS t FROM h GROUP BY 1) SELECT g.symbol, g.t, round(coalesce(m, 0), 6) AS sentiment_mean, coalesce(n, 0) AS post_count, (n IS NULL)::INT AS sentiment_missing FROM g LEFT JOIN h ON h.symbol = g.symbol AND h.t = g.t")
def sentiment_hourly_by_symbol(spark, sf_dir):
    return result(T.hourly_by_symbol(scored(spark, sf_dir)), "symbol", "timestamp", "sentiment_mean", "post_count", "sentiment_missing")


@query("SELECT doc_id, CASE WHEN doc_id % 3 != 0 THEN 'archive' ELSE 'rolling' END AS kept FROM documents")
def posts_merge(spark, sf_dir):
    """Archive and rolling set, which overlap, as one table with each post once, the archive's first."""
    p = posts(spark, sf_dir).select("doc_id", "text")
    archive, rolling = p.where("doc_id % 3 != 0").withColumn("kept", F.lit("archive")), p.where("doc_id % 2 = 0 or doc_id % 3 = 0").withColumn("kept", F.lit("rolling"))
    return T.merge_posts(archive, rolling, "doc_id", ["text"]).select("doc_id", "kept")
