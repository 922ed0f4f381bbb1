"""Queries of feeds, sinks, joins, sets, texts and the graph of nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import graph, sets, spectral, text
from tapeloom.operators.timeseries import returns
from tapeloom.plans.ladders import SNAP, snap
from tapeloom.plans.panels import _IN, CORR, DEGREES, NEGATIONS, NEGATIVE, POSITIVE
from tapeloom.plans.registry import DIMS, MONTHLY, RETURNS, W, query
from tapeloom.plans.streams import ALERTS
from tapeloom.sources import feeds
from tapeloom.sources import market as m
from tapeloom.streaming import alerts

_CENTS = lambda c: f"floor({c} * 100 + 0.5)::BIGINT"


@query("s02_coded_quotes", f"WITH {MONTHLY} SELECT symbol, ts, 'S' || symbol AS code, {_CENTS('close')} / 100 AS price, {_CENTS('high')} / 100 AS high, {_CENTS('low')} / 100 AS low, {_CENTS('open')} / 100 AS prev_close FROM bars")
def s02(spark, d):
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("string")
    body = F.concat(F.lit('{"data":{"f57":"S'), "symbol", F.lit('","f58":"n","f43":'), cents("close"), F.lit(',"f44":'), cents("high"), F.lit(',"f45":'), cents("low"), F.lit(',"f60":'), cents("open"), F.lit("}}"))
    return m.monthly_bars(spark, d).select("symbol", "ts", feeds.coded_quote(body).alias("q")).select("symbol", "ts", "q.code", "q.price", "q.high", "q.low", "q.prev_close")


@query("s04_bars_by_priority", f"WITH {MONTHLY}, a AS (SELECT symbol, ts, {_CENTS('close')} / 100 AS close FROM bars WHERE n >= 3), b AS (SELECT symbol, ts, {_CENTS('open')} / 100 AS close FROM bars WHERE n >= 2), c AS (SELECT symbol, ts, {_CENTS('low')} / 100 AS close FROM bars), u AS (SELECT *, 0 AS provider FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c) SELECT symbol, ts, close, provider FROM u QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY provider) = 1")
def s04(spark, d):
    """Three providers: delimited lines, coded JSON and plain rows; each has what the ones after it lack."""
    b = m.monthly_bars(spark, d)
    cents = lambda c: (F.floor(F.col(c) * 100 + 0.5) / 100)
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd"), F.lit("0"), cents("close").cast("string"), F.lit("0"), F.lit("0"), F.lit("1"))
    body = F.concat(F.lit('{"data":{"f43":'), F.floor(F.col("open") * 100 + 0.5).cast("string"), F.lit("}}"))
    first = b.filter("n >= 3").select("symbol", "ts", feeds.csv_bar(line)["close"].alias("close"))
    second = b.filter("n >= 2").select("symbol", "ts", feeds.coded_quote(body)["price"].alias("close"))
    return feeds.by_priority(first, second, b.select("symbol", "ts", cents("low").alias("close")), keys=["symbol", "ts"])


@query("s12_fundamental_trends", "WITH y AS (SELECT l_suppkey AS key, year(l_shipdate) AS period, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1, 2), q AS (SELECT *, lag(revenue) OVER (PARTITION BY key ORDER BY period) AS before, max(period) OVER (PARTITION BY key) AS last FROM y) SELECT key, period::INTEGER AS period, revenue, before, CASE WHEN revenue / before - 1 > 0.05 THEN 'up' WHEN revenue / before - 1 < -0.05 THEN 'down' WHEN before IS NOT NULL THEN 'flat' ELSE 'unknown' END AS trend FROM q WHERE period = last")
def s12(spark, d):
    y = m.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.year("l_shipdate").alias("period")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return feeds.trends(y, "revenue")


@query("s14_jsonp_lists", "SELECT doc_id, source, length(coalesce(source, '')) AS size FROM documents")
def s14(spark, d):
    body = F.concat(F.lit("callback("), F.to_json(F.struct(F.coalesce("source", F.lit("")).alias("title"))), F.lit(");"))
    return m.table(spark, d, "documents").select("doc_id", "source", F.length(feeds.jsonp(body, "struct<title:string>")["title"]).cast("long").alias("size"))


@query("s15_alert_insert", f"WITH {ALERTS}, z AS (SELECT kind, severity FROM a UNION ALL SELECT 'manual', 'low') SELECT kind, severity, count(*) AS n FROM z GROUP BY 1, 2")
def s15(spark, d):
    """Many alerts and then one more are appended to a table."""
    path = alerts.scratch(spark, "inserted")
    many = alerts.alerts(m.table(spark, d, "events")).select("kind", "severity")
    alerts.insert(many, path)
    alerts.insert(spark.createDataFrame([("manual", "low")], "kind string, severity string"), path)
    return spark.read.schema(many.schema).parquet(path).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query("s18_history", f"WITH {MONTHLY}, {RETURNS} SELECT symbol, count(*) AS n, round(avg(ret), 6) AS mean FROM r GROUP BY 1")
def s18(spark, d):
    one = returns(m.monthly_bars(spark, d)).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean"))
    return feeds.saved(one, alerts.scratch(spark, "history"))


@query("s19_markdown_report", f"WITH {MONTHLY}, q AS (SELECT symbol, count(*) AS n, sum(volume)::BIGINT AS volume FROM bars GROUP BY 1) SELECT symbol, '# Symbol ' || symbol || chr(10) || '- bars: ' || n || chr(10) || '- volume: ' || volume AS page FROM q")
def s19(spark, d):
    q = m.monthly_bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("volume").cast("long").alias("volume"))
    return feeds.report(q, F.concat(F.lit("Symbol "), F.col("symbol")), ("bars", F.col("n")), ("volume", F.col("volume"))).select("symbol", "page")


@query("j03_enriched_signals", f"WITH {SNAP}, {DIMS}, sg AS (SELECT symbol, ts, CASE WHEN rsi14 < 40 THEN 'buy' ELSE 'sell' END AS signal FROM snap WHERE rsi14 < 40 OR rsi14 > 60), pr AS (SELECT symbol, ts, close, volume, prev FROM snap WHERE volume > 20) SELECT sg.symbol, sg.ts, signal, round(close + 1e-9, 4) AS close, volume, round(prev + 1e-9, 4) AS prev, industry, pr.close IS NULL AS halted FROM sg LEFT JOIN pr USING (symbol, ts) LEFT JOIN dims USING (symbol)")
def j03(spark, d):
    s = snap(spark, d)
    signals = s.filter("rsi14 < 40 OR rsi14 > 60").select("symbol", "ts", F.when(F.col("rsi14") < 40, "buy").otherwise("sell").alias("signal"))
    out = sets.enriched(signals, (s.filter("volume > 20").select("symbol", "ts", "close", "volume", "prev"), ["symbol", "ts"]), (m.industries(spark, d).select("symbol", "industry"), ["symbol"]))
    return out.select("symbol", "ts", "signal", F.round(F.col("close") + 1e-9, 4).alias("close"), "volume", F.round(F.col("prev") + 1e-9, 4).alias("prev"), "industry", F.col("close").isNull().alias("halted"))


@query("j04_lookup_default", "SELECT doc_id, source, coalesce(w, 0.6) AS weight FROM documents LEFT JOIN (VALUES ('web', 0.5::DOUBLE), ('news', 1.0::DOUBLE)) t(source, w) USING (source)")
def j04(spark, d):
    weights = spark.createDataFrame([("web", 0.5), ("news", 1.0)], "source string, weight double")
    return sets.looked_up(m.table(spark, d, "documents").select("doc_id", "source"), weights, "source", "weight", F.lit(0.6))


_MEANS = f"{MONTHLY}, {RETURNS}, {DIMS}, im AS (SELECT industry AS name, ts, avg(ret) AS x FROM r JOIN dims USING (symbol) GROUP BY 1, 2)"


@query("j06_pairs_of_industries", f"WITH {_MEANS} SELECT a.name AS a, b.name AS b, count(*) AS n, round({CORR.format(a='a.x', b='b.x')}, 5) AS corr FROM im a JOIN im b ON a.ts = b.ts AND a.name < b.name GROUP BY 1, 2")
def j06(spark, d):
    rows = returns(m.monthly_bars(spark, d)).join(m.industries(spark, d).select("symbol", F.col("industry").alias("name")), "symbol").groupBy("name", "ts").agg(F.avg("ret").alias("x"))
    return sets.pair_correlations(rows).select("a", "b", "n", F.round("corr", 5).alias("corr"))


@query("j08_time_of_day", "SELECT event_id, CASE WHEN hour(ts) < 10 THEN 1.2 WHEN hour(ts) < 12 THEN 1.1 WHEN hour(ts) < 14 THEN 1.3 ELSE 1.4 END::DOUBLE AS factor FROM events")
def j08(spark, d):
    day = spark.createDataFrame([(0, 10, 1.2), (10, 12, 1.1), (12, 14, 1.3), (14, 24, 1.4)], "low int, high int, factor double")
    return sets.in_interval(m.table(spark, d, "events").select("event_id", "ts"), F.hour("ts"), day).select("event_id", "factor")


@query("j09_executed_only", f"WITH {SNAP} SELECT s.symbol, count(*) AS executed FROM snap s SEMI JOIN (SELECT symbol, ts FROM bars WHERE close > 0) p ON s.symbol = p.symbol AND s.ts = p.ts ANTI JOIN (SELECT symbol, ts FROM bars WHERE volume < 10) h ON s.symbol = h.symbol AND s.ts = h.ts WHERE rsi14 < 45 GROUP BY 1")
def j09(spark, d):
    b, key = m.monthly_bars(spark, d), ["symbol", "ts"]
    wanted = snap(spark, d).filter("rsi14 < 45").select(*key)
    return wanted.join(b.filter("close > 0").select(*key), key, "left_semi").join(b.filter("volume < 10").select(*key), key, "left_anti").groupBy("symbol").agg(F.count("*").alias("executed"))


_SETS = "a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW')"
for _name, _op, _do in (("u01_intersection", "INTERSECT", lambda a, b: a.intersect(b)), ("u02_u03_union", "UNION", lambda a, b: a.unionByName(b).distinct()), ("u04_difference", "EXCEPT", lambda a, b: a.exceptAll(b).distinct())):

    @query(_name, f"WITH {_SETS} SELECT k FROM a {_op} SELECT k FROM b")
    def _sets(spark, d, do=_do):
        o = m.table(spark, d, "orders")
        of = lambda p: o.filter(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("k")).distinct()
        return do(of("1-URGENT"), of("5-LOW"))


@query("l06_recent_rings", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INTEGER AS back FROM events QUALIFY back <= 500")
def l06(spark, d):
    return sets.most_recent(m.table(spark, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 500).select("event_type", "event_id", "back")


@query("a16_missing_rates", "SELECT count(*) AS n, round(count(*) FILTER (WHERE text IS NULL OR text = '') / count(*), 6) AS text_missing, round(count(*) FILTER (WHERE lang IS NULL) / count(*), 6) AS lang_missing, round(count(*) FILTER (WHERE source IS NULL) / count(*), 6) AS source_missing FROM documents")
def a16(spark, d):
    rate = lambda cond: F.round(F.count_if(cond) / F.count("*"), 6)
    return m.table(spark, d, "documents").agg(F.count("*").alias("n"), rate(F.col("text").isNull() | (F.col("text") == "")).alias("text_missing"), rate(F.col("lang").isNull()).alias("lang_missing"), rate(F.col("source").isNull()).alias("source_missing"))


@query("st04_technical_alerts", f"WITH {SNAP}, h AS (SELECT symbol, arg_max(rsi14, ts) AS rsi, arg_max(hi20, ts) AS hi, arg_max(lo20, ts) AS lo FROM snap GROUP BY 1), e AS (SELECT event_id, user_id AS symbol, value * 40 AS price FROM events), j AS (SELECT * FROM e JOIN h USING (symbol)), al AS (SELECT event_id, 'overbought' AS kind FROM j WHERE rsi > 70 UNION ALL SELECT event_id, 'oversold' FROM j WHERE rsi < 30 UNION ALL SELECT event_id, 'breakout' FROM j WHERE price > hi * 1.005 UNION ALL SELECT event_id, 'breakdown' FROM j WHERE price < lo * 0.995) SELECT event_id, kind FROM al")
def st04(spark, d):
    """A stream of prices against what is known of each symbol: a stream-static join, and a row for each rule that is met."""
    s = snap(spark, d)
    history = s.groupBy(F.col("symbol")).agg(F.max_by("rsi14", "ts").alias("rsi"), F.max_by("hi20", "ts").alias("hi"), F.max_by("lo20", "ts").alias("lo"))
    prices = alerts.events_stream(spark, d).select("event_id", F.col("user_id").alias("symbol"), (F.col("value") * 40).alias("price"))
    return alerts.to_table(alerts.technical(prices, history), "technical")


_WORDS = "w AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS words FROM documents)"
_PHRASES = (["of the", "and the", "the"], ["to be", "not", "to"])
_ALT = "|".join(sorted([*_PHRASES[0], *_PHRASES[1]], key=lambda p: (-len(p), p)))


@query("t02_longest_phrases", f"WITH f AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'), '\\b({_ALT})\\b') AS found FROM documents), q AS (SELECT doc_id, len(list_filter(found, lambda x: x IN ({_IN(_PHRASES[0])})))::INTEGER AS pos, len(list_filter(found, lambda x: x IN ({_IN(_PHRASES[1])})))::INTEGER AS neg FROM f) SELECT doc_id, pos, neg, round(coalesce((pos - neg)::DOUBLE / nullif(pos + neg, 0), 0.0), 6) AS score FROM q")
def t02(spark, d):
    return text.phrase_score(m.table(spark, d, "documents"), *_PHRASES)


def _sentence_sql() -> str:
    def hit(word: str, sign: float) -> str:
        at, before = f"instr(s, '{word}')", f"substring(s, greatest(1, instr(s, '{word}') - 4), least(4, instr(s, '{word}') - 1))"
        return f"CASE WHEN {at} > 0 THEN {sign} * CASE WHEN contains({before}, 'in ') THEN 1.5 ELSE 1.0 END * CASE WHEN contains({before}, 'is ') THEN -1.0 ELSE 1.0 END END"

    hits = [hit(w, 1.0) for w in ("that", "there")] + [hit(w, -1.0) for w in ("not", "ther")]
    return f"WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[.!?]+')) AS s FROM documents), h AS (SELECT doc_id, unnest([{', '.join(hits)}])::DOUBLE AS h FROM s), q AS (SELECT doc_id, count(h) AS n, sum(h) AS t FROM h GROUP BY 1), z AS (SELECT doc_id, n, greatest(-1.0, least(1.0, coalesce(t / nullif(n * 2.0::DOUBLE, 0), 0.0))) AS score FROM q) SELECT doc_id, n::INTEGER AS hits, round(score, 5) AS score, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM z"


@query("t01_sentence_lexicon", _sentence_sql())
def t01(spark, d):
    return text.sentence_score(m.table(spark, d, "documents"), ["that", "there"], ["not", "ther"], "is ", "in ").select("doc_id", "hits", "score", "label")


@query("c22_document_lexicon", f"WITH {_WORDS}, q AS (SELECT doc_id, len(list_filter(words, lambda x: x IN ({_IN(POSITIVE)}))) AS p, len(list_filter(words, lambda x: x IN ({_IN(NEGATIVE)}))) AS n, len(list_filter(words, lambda x: x IN ({_IN(NEGATIONS)}))) > 0 AS turned, greatest(1.0, CASE WHEN list_contains(words, 'in') THEN 1.5 ELSE 1.0 END)::DOUBLE AS degree FROM w), z AS (SELECT doc_id, CASE WHEN turned THEN n ELSE p END AS pos, CASE WHEN turned THEN p ELSE n END AS neg, degree FROM q), s AS (SELECT *, greatest(-1.0, least(1.0, coalesce((pos - neg) * degree / nullif(pos + neg, 0), 0.0))) AS score FROM z) SELECT doc_id, pos::INTEGER AS pos, neg::INTEGER AS neg, round(score, 6) AS score, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS label FROM s")
def c22(spark, d):
    return text.document_score(m.table(spark, d, "documents"), POSITIVE, NEGATIVE, NEGATIONS, {k: v for k, v in DEGREES.items() if v > 1})


_LEX = f"{_WORDS}, lx AS (SELECT doc_id, source, coalesce((len(list_filter(words, lambda x: x IN ({_IN(POSITIVE)}))) - len(list_filter(words, lambda x: x IN ({_IN(NEGATIVE)}))))::DOUBLE / nullif(len(list_filter(words, lambda x: x IN ({_IN(POSITIVE + NEGATIVE)}))), 0), 0.0) AS score FROM w)"


@query("a10_a11_weighted_sentiment", f"WITH {_LEX}, q AS (SELECT score, CASE source WHEN 'web' THEN 0.5 WHEN 'news' THEN 1.0 ELSE 0.6 END::DOUBLE * exp(-0.1::DOUBLE * (doc_id % 30)) AS w FROM (SELECT doc_id, source, round(score, 6) AS score FROM lx)) SELECT count(*) AS n, round(sum(w * score) / sum(w), 5) AS score, round(avg(CASE WHEN score > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS positive_share FROM q")
def a10(spark, d):
    return text.weighted_by_source(text.lexicon_score(m.table(spark, d, "documents"), POSITIVE, NEGATIVE), {"web": 0.5, "news": 1.0})


@query("t07_t08_blended_mood", f"WITH {_LEX}, q AS (SELECT doc_id, 0.6::DOUBLE * score + 0.4::DOUBLE * score * score * sign(score) AS ensemble, 0.4::DOUBLE * score + 0.3::DOUBLE * score / 2 + 0.3::DOUBLE * 0.1 AS blend FROM lx) SELECT doc_id, round(ensemble + 1e-9, 5) AS ensemble, CASE WHEN ensemble > 0.15 THEN 'positive' WHEN ensemble < -0.15 THEN 'negative' ELSE 'neutral' END AS label, round(blend + 1e-9, 5) AS blend, CASE WHEN blend > 0.4 THEN 'strong_bullish' WHEN blend > 0.1 THEN 'bullish' WHEN blend > -0.1 THEN 'neutral' WHEN blend > -0.4 THEN 'bearish' ELSE 'strong_bearish' END AS level FROM q")
def t07(spark, d):
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z]+)"), 1)
    count = lambda known: F.size(F.filter("words", lambda w: w.isin(known)))
    t = m.table(spark, d, "documents").select("doc_id", words.alias("words")).select("doc_id", F.coalesce(F.try_divide((count(POSITIVE) - count(NEGATIVE)).cast("double"), count(POSITIVE + NEGATIVE)), F.lit(0.0)).alias("s"))
    s = F.col("s")
    return text.moods(t.select("doc_id", s.alias("a"), (s * s * F.signum(s)).alias("b"), s.alias("news"), (s / 2).alias("social"), F.lit(0.1).alias("technical"))).select("doc_id", F.round(F.col("ensemble") + 1e-9, 5).alias("ensemble"), "label", F.round(F.col("blend") + 1e-9, 5).alias("blend"), "level")


#: Nations: those of one region, and those that trade; the heavier tie holds. As many nodes as the dimension has.
_NATION = """n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), tr AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey AND l_quantity > 49),
e0 AS (SELECT a.k AS src, b.k AS dst, CASE WHEN a.r = b.r THEN 0.8 WHEN tr.a IS NOT NULL THEN 0.3 END::DOUBLE AS w FROM n a JOIN n b ON a.k <> b.k LEFT JOIN tr ON tr.a = a.k AND tr.b = b.k), e AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e0 WHERE w IS NOT NULL)"""


def nations(spark: SparkSession, d: str) -> DataFrame:
    n = m.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    line = m.table(spark, d, "lineitem").filter("l_quantity > 49").select("l_orderkey", "l_suppkey")
    who = m.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(m.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    trade = line.join(who, F.col("l_orderkey") == F.col("o_orderkey")).join(m.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey")).filter("src != dst").select("src", "dst").distinct()
    region = n.select(F.col("k").alias("src"), "r").join(n.select(F.col("k").alias("dst"), "r"), "r").filter("src != dst").select("src", "dst")
    return graph.weighted({0.8: region, 0.3: trade})


@query("g01_nation_edges", f"WITH {_NATION} SELECT src, dst, round(w, 6) AS w FROM e")
def g01(spark, d):
    return nations(spark, d).select("src", "dst", F.round("w", 6).alias("w"))


def _rank_sql(rounds: int = 20) -> str:
    steps = ["r0 AS (SELECT k, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT n.k, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * coalesce(g.got, 0) AS rank FROM n LEFT JOIN (SELECT dst, sum(w * rank) AS got FROM e JOIN r{i} ON src = k GROUP BY 1) g ON n.k = g.dst)")
    return f"WITH {_NATION.replace('e AS (', 'e AS MATERIALIZED (')}, {', '.join(steps)} SELECT k, round(coalesce((rank - min(rank) OVER ()) / nullif(max(rank) OVER () - min(rank) OVER (), 0), 0.0) * 32, 5) AS rank FROM r{rounds}"


@query("g03_nation_rank", _rank_sql())
def g03(spark, d):
    nodes = m.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return graph.small_rank(nodes, nations(spark, d), rounds=20, scale=32.0).select("k", F.round("rank", 5).alias("rank"))


@query("g05_nation_embedding")
def g05(spark, d):
    """Four lowest eigenvectors of the nations' ties."""
    nodes = m.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    v, _ = spectral.embedding(nodes, nations(spark, d), 4)
    return v.select("k", *(F.round(F.get("v", F.lit(j)) + 1e-9, 5).alias(f"v{j}") for j in range(4)))


@query("g04_g06_neighbourhoods", f"WITH {_NATION}, f0 AS (SELECT s_nationkey AS k, avg(s_acctbal) / 1000 AS f FROM supplier GROUP BY 1), f1 AS (SELECT n.k, coalesce(sum(w * f), 0.0) AS f FROM n LEFT JOIN e ON e.src = n.k LEFT JOIN f0 ON f0.k = e.dst GROUP BY 1), f2 AS (SELECT n.k, coalesce(sum(w * f), 0.0) AS f FROM n LEFT JOIN e ON e.src = n.k LEFT JOIN f1 ON f1.k = e.dst GROUP BY 1) SELECT n.k, round(coalesce(f0.f, 0.0), 5) AS own, round(f1.f, 5) AS near, round(f2.f, 5) AS far FROM n LEFT JOIN f0 USING (k) JOIN f1 USING (k) JOIN f2 USING (k)")
def g04(spark, d):
    nodes = m.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    own = m.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.avg("s_acctbal") / 1000).alias("f"))
    return graph.neighbourhoods(nodes, nations(spark, d), own).select("k", *(F.round(c, 5).alias(c) for c in ("own", "near", "far")))


@query("p42_c12_diversification", f"WITH {_MEANS}, pc AS (SELECT a.name AS a, b.name AS b, {CORR.format(a='a.x', b='b.x')} AS c FROM im a JOIN im b ON a.ts = b.ts AND a.name < b.name GROUP BY 1, 2), k AS (SELECT count(DISTINCT name) AS n FROM im), q AS (SELECT 1 - (2 * sum(greatest(0.0, least(1.0, c + 0.15))) + max(n)) / (max(n) * max(n)) AS score FROM pc, k) SELECT round(score, 5) AS score, round(1 - 0.3 * score, 5) AS adjustment FROM q")
def p42(spark, d):
    """Correlations of industries, shifted for a falling market, and what their mean leaves."""
    rows = returns(m.monthly_bars(spark, d)).join(m.industries(spark, d).select("symbol", F.col("industry").alias("name")), "symbol").groupBy("name", "ts").agg(F.avg("ret").alias("x"))
    total = sets.pair_correlations(rows).agg(F.sum(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("corr") + 0.15))).alias("t"))
    n = rows.select("name").distinct().agg(F.count("*").alias("n"))
    score = 1 - (2 * F.col("t") + F.col("n")) / (F.col("n") * F.col("n"))
    return total.crossJoin(F.broadcast(n)).select(F.round(score, 5).alias("score"), F.round(1 - 0.3 * score, 5).alias("adjustment"))


@query("c23_source_mood", f"WITH {_LEX}, q AS (SELECT source, round(score, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS back FROM lx) SELECT source, count(*) AS texts, round(avg(score), 6) AS score FROM q WHERE back <= 10 GROUP BY 1")
def c23(spark, d):
    """The mood of each source's ten newest texts: a report of the last ones."""
    lex = text.lexicon_score(m.table(spark, d, "documents"), POSITIVE, NEGATIVE)
    return sets.most_recent(lex, "source", [F.desc("doc_id")], 10).groupBy("source").agg(F.count("*").alias("texts"), F.round(F.avg("score"), 6).alias("score"))
