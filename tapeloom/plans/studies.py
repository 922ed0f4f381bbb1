"""Queries of augmented series, folds in time, boards, contrasts and ensembles of scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import rules, studies, text
from tapeloom.plans.panels import _IN, _WORDS, DEGREES, NEGATIONS, NEGATIVE, POSITIVE
from tapeloom.plans.registry import ALL, MONTHLY, W, query
from tapeloom.sources import market as m


def _u(i: str, salt: int) -> str:
    return f"(((symbol * 1000003 + {i} * 7919 + {salt} * 104729 + 7) % 1000000007 * 48271 % 2147483647 * 48271 % 2147483647 + 1) / 2147483648.0::DOUBLE)"


def _z(i: str, salt: int) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({_u(i, salt)})) * cos(2 * pi() * {_u(i, salt + 1)}))"


_ANGLE = f"((2 * {_u('0', 30)} - 1) * pi())"


@query("w56_augmented", f"""WITH {MONTHLY}, b AS (SELECT symbol, ts, close, volume, row_number() {W} - 1 AS i FROM bars), k AS (SELECT *, sum({_z('i', 20)} * 0.2::DOUBLE) {ALL} AS walk FROM b),
t AS (SELECT *, min(walk) OVER p AS low, max(walk) OVER p AS high, count(*) OVER p AS n FROM k WINDOW p AS (PARTITION BY symbol)), a AS (SELECT *, least(n - 1, floor(round((walk - low) / (high - low + 1e-10::DOUBLE) * n, 7))::BIGINT) AS at FROM t)
SELECT a.symbol, a.ts, round(a.close + {_z('a.i', 10).replace('symbol', 'a.symbol')} * 0.05::DOUBLE, 5) AS jittered, round(a.close * (1 + {_z('0', 12).replace('symbol', 'a.symbol')} * 0.1::DOUBLE), 4) AS scaled,
round(a.close * cos({_ANGLE.replace('symbol', 'a.symbol')}) + a.volume * sin({_ANGLE.replace('symbol', 'a.symbol')}), 4) AS turned_close, round(a.volume * cos({_ANGLE.replace('symbol', 'a.symbol')}) - a.close * sin({_ANGLE.replace('symbol', 'a.symbol')}), 4) AS turned_volume,
round(b.close + 1e-9, 6) AS warped FROM a JOIN b ON a.symbol = b.symbol AND a.at = b.i""")
def w56(spark, d):
    out = studies.augmented(m.monthly_bars(spark, d))
    return out.select("symbol", "ts", F.round("jittered", 5).alias("jittered"), *(F.round(c, 4).alias(c) for c in ("scaled", "turned_close", "turned_volume")), F.round(F.col("warped") + 1e-9, 6).alias("warped"))


@query("c36_fold_ic", f"""WITH {MONTHLY}, dt AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS d, count(*) OVER () AS dates FROM (SELECT DISTINCT ts FROM bars)),
y AS (SELECT symbol, ts, CASE WHEN f > 0.02 THEN 1 WHEN f < -0.02 THEN -1 WHEN f IS NOT NULL THEN 0 END::DOUBLE AS y FROM (SELECT symbol, ts, lead(close, 5) {W} / close - 1 - 0.0015 AS f FROM bars)),
x AS ({' UNION ALL '.join(f'SELECT {p} AS period, symbol, ts, close / lag(close, {p}) {W} - 1 AS x FROM bars' for p in (1, 3, 5, 10))}),
rw AS (SELECT period, x, y, d, dates FROM x JOIN y USING (symbol, ts) JOIN dt USING (ts) WHERE x IS NOT NULL AND y IS NOT NULL),
fo AS (SELECT DISTINCT f, dates - (6 - f) * (dates // 6) AS lo, dates - (5 - f) * (dates // 6) AS hi FROM dt, range(1, 6) r(f) WHERE dates >= 6),
tr AS (SELECT period, f, count(*) AS n, sign(round(count(*) * sum(x * y) - sum(x) * sum(y), 6)) AS slope FROM rw JOIN fo ON d < lo - 2 GROUP BY 1, 2),
te AS (SELECT period, f, count(*) AS n, coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0.0) AS c FROM rw JOIN fo ON d >= lo AND d < hi GROUP BY 1, 2),
g AS (SELECT period, f, slope * c AS ic FROM tr JOIN te USING (period, f) WHERE tr.n >= 20 AND te.n >= 5 AND slope <> 0 AND c <> 0),
z AS (SELECT period, count(f) AS folds, round(coalesce(avg(ic), 0.0), 6) AS ic FROM (SELECT DISTINCT period FROM rw) LEFT JOIN g USING (period) GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY ic DESC, period) AS place FROM z""")
def c36(spark, d):
    return studies.fold_ic(m.monthly_bars(spark, d))


_CODE = "lpad((symbol * 7919 % 1000000)::VARCHAR, 6, '0')"


@query("c33_board_heat", f"""WITH {MONTHLY}, q AS (SELECT CASE WHEN left({_CODE}, 3) IN ('688', '689') THEN 'innovation' WHEN left({_CODE}, 3) IN ('300', '301') THEN 'growth' WHEN left({_CODE}, 3) IN ('002', '003') THEN 'small' WHEN left({_CODE}, 1) IN ('8', '4') THEN 'north' ELSE 'main' END AS board, amount, amount * coalesce((2 * outer_vol - volume) / nullif(volume, 0), 0.0) AS net FROM bars),
f AS (SELECT board, count(*) AS bars, coalesce(100 * sum(net) / nullif(sum(amount), 0), 0.0) AS flow FROM q GROUP BY 1)
SELECT board, bars, round(flow, 5) AS flow, CASE WHEN flow > 30 THEN 'strong_inflow' WHEN flow > 10 THEN 'moderate_inflow' WHEN flow > -10 THEN 'neutral' WHEN flow > -30 THEN 'moderate_outflow' ELSE 'strong_outflow' END AS level FROM f""")
def c33(spark, d):
    return rules.board_heat(m.monthly_bars(spark, d), F.lpad((F.col("symbol") * 7919 % 1000000).cast("string"), 6, "0"))


CONTRASTS = ("but", "with")
_LIT = f"{_WORDS}, u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, words FROM w)"


def _hit_sql(contrast: bool) -> str:
    """A hit's value; slices before the first word are guarded by its place."""
    any_of = lambda k, ws: f"i > 1 AND len(list_filter(words[greatest(i - {k}, 1):i - 1], lambda v: v IN ({_IN(ws)}))) > 0"
    degree = " ".join(f"WHEN i > 1 AND words[i - 1] = '{w}' THEN {v}" for w, v in DEGREES.items())
    own = f"CASE WHEN word IN ({_IN(POSITIVE)}) THEN 1.0 ELSE -1.0 END * CASE {degree} ELSE 1.0 END * CASE WHEN {any_of(3, NEGATIONS)} THEN -1.0 ELSE 1.0 END"
    return f"({own}{f' * CASE WHEN {any_of(5, CONTRASTS)} THEN -0.5 ELSE 1.0 END' if contrast else ''})::DOUBLE"


_SHARE = "coalesce(sum({h}) / nullif(sum(abs({h})), 0), 0.0)"
_H = f"h AS (SELECT doc_id, CASE WHEN word IN ({_IN(POSITIVE)}) THEN 1.0 ELSE -1.0 END::DOUBLE AS a, {_hit_sql(False)} AS b, {_hit_sql(True)} AS c FROM u WHERE word IN ({_IN(POSITIVE + NEGATIVE)}))"


@query("t04_contrasted_score", f"WITH {_LIT}, {_H} SELECT w.doc_id, round({_SHARE.format(h='c')}, 6) AS score, count(c)::INTEGER AS hits FROM w LEFT JOIN h USING (doc_id) GROUP BY 1")
def t04(spark, d):
    return text.modified_score(m.table(spark, d, "documents"), POSITIVE, NEGATIVE, NEGATIONS, DEGREES, CONTRASTS)


@query("c24_news_ensemble", f"""WITH {_LIT}, {_H}, s AS (SELECT w.doc_id, source, {', '.join(f'round({_SHARE.format(h=h)}, 6) AS {h}' for h in 'abc')} FROM w LEFT JOIN h USING (doc_id) GROUP BY 1, 2),
z AS (SELECT source, count(*) AS n_news, (0.5::DOUBLE * avg(a) + 0.3::DOUBLE * avg(b) + 0.2::DOUBLE * avg(c)) AS score FROM s GROUP BY 1) SELECT source, n_news, round(score, 5) AS score, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM z""")
def c24(spark, d):
    out = text.news_ensemble(m.table(spark, d, "documents"), POSITIVE, NEGATIVE, NEGATIONS, DEGREES, CONTRASTS, (0.5, 0.3, 0.2))
    return out.withColumn("score", F.round("score", 5))
