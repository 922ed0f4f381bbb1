"""Rule tables over a snapshot: signals, states, scores, stops, costs and verdicts. Thresholds and points are fixed values of the rules."""

from __future__ import annotations

from tapeloom.operators.steps import ladder, named, points, rules

_RATIO = "coalesce(outer_vol / nullif(inner_vol, 0), 1.0)"
_SHARE = "coalesce(abs(close - open) / nullif(high - low, 0), 0.0)"
_BODY = "coalesce((close - open) / nullif(open, 0), 0.0)"

GUARDED = rules({"one": "coalesce(ret, 0.0)"}, out="one:6", where="close > 0 AND rn >= 15 AND abs(ret) < 1e300")

VOLUME = {
    "pressure": _RATIO,
    "bands": named(high_turnover="turnover > 200", medium_turnover="turnover > 100 AND turnover <= 200", low_turnover="turnover <= 100", rise_on_volume="change > 0 AND turnover > 150", rise_without_volume="change > 0 AND turnover < 80", fall_on_volume="change <= 0 AND turnover > 150", fall_without_volume="change <= 0 AND turnover < 80", buyers=f"{_RATIO} > 1.3", sellers=f"{_RATIO} < 0.7", even=f"{_RATIO} >= 0.7 AND {_RATIO} <= 1.3"),
    "volume_score": "least(100, greatest(0, " + points(50, ("turnover > 200", 10), ("turnover > 100 AND turnover <= 200", 5), ("turnover <= 100", 5), ("turnover > 150", 15), ("turnover < 80", 10), (f"{_RATIO} > 1.3 OR {_RATIO} < 0.7", 15), (f"{_RATIO} >= 0.7 AND {_RATIO} <= 1.3", 5)) + "))",
}
VOLUME_BANDS = rules(VOLUME, {"strength": ladder("volume_score", (70, "strong"), (40, "medium"), rest="weak"), "side": "CASE WHEN pressure > 1.1 THEN 'buy' WHEN pressure < 0.9 THEN 'sell' ELSE 'even' END"}, out="pressure:6 bands volume_score strength side")

POSITION = {"to_high": "(close / year_high - 1) * 100", "to_low": "(close / year_low - 1) * 100", "opened": "CASE WHEN open > close * 1.02 THEN 'high' WHEN open < close * 0.98 THEN 'low' ELSE 'flat' END"}
PLACE = {"place": "CASE WHEN to_high > -5 THEN 'near_high' WHEN to_low < 5 THEN 'near_low' ELSE 'middle' END", "position_score": "least(100, " + points(50, ("to_high > -5 OR to_low < 5", 15), ("opened = 'high'", 10)) + ")"}
PRICE_POSITION = rules(POSITION, PLACE, out="to_high:6 to_low:6 opened place position_score")

MOOD = {"mood": ladder("rsi", (80, "extreme_greed"), (70, "greed"), (60, "leaning_up"), (40, "neutral"), (30, "leaning_down"), (20, "fear"), rest="extreme_fear")}
SENTIMENT = rules(MOOD, {"act": "CASE mood WHEN 'extreme_greed' THEN 'reduce' WHEN 'greed' THEN 'hold' WHEN 'leaning_up' THEN 'hold' WHEN 'neutral' THEN 'watch' WHEN 'leaning_down' THEN 'reduce' WHEN 'fear' THEN 'consider' ELSE 'buy' END"}, out="rsi:6 mood act")

_TREND = lambda c: ladder(c, (55, "up"), (45, "flat"), rest="down").replace(f"{c} > 45", f"{c} >= 45")
#: Over the strengths of three cycles: day, week, month.
RESONANCE = rules(
    {f"{c}_trend": _TREND(c) for c in ("day", "week", "month")},
    {k: " + ".join(f"CASE WHEN {c}_trend = '{k}' THEN 1 ELSE 0 END" for c in ("day", "week", "month")) for k in ("up", "down")},
    {"resonance": "CASE WHEN up >= 2 AND down = 0 THEN 'all_up' WHEN down >= 2 AND up = 0 THEN 'all_down' WHEN up >= 2 THEN 'two_up' WHEN down >= 2 THEN 'two_down' ELSE 'none' END", "score": "up * 10 + (1 - down / 3.0) * 10 + CASE WHEN day_trend = week_trend THEN 10 ELSE 0 END + CASE WHEN day_trend = month_trend THEN 5 ELSE 0 END"},
    out="day_trend week_trend month_trend resonance score:4",
)

_PATTERN = points(50, (f"least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < abs(close - open)", 10), (f"high - greatest(open, close) > 2 * abs(close - open) AND least(open, close) - low < abs(close - open)", 5), (f"{_BODY} > 0.05 AND {_SHARE} > 0.7", 20), (f"{_BODY} < -0.05 AND {_SHARE} > 0.7", -20))
KLINE = rules(
    VOLUME | POSITION | MOOD,
    PLACE | {"pattern_score": f"least(100, greatest(0, {_PATTERN}))", "rsi_score": "CASE WHEN rsi >= 50 THEN rsi ELSE 100 - rsi END"},
    {
        "bullish": points(0, (f"{_BODY} > 0.05 AND {_SHARE} > 0.7", 1), ("change > 0 AND turnover > 150", 1), ("pressure > 1.3", 1), ("place = 'near_low'", 1), ("mood = 'extreme_fear'", 1)),
        "bearish": points(0, (f"{_BODY} < -0.05 AND {_SHARE} > 0.7", 1), ("change <= 0 AND turnover > 150", 1), ("pressure < 0.7", 1), ("place = 'near_high'", 1), ("mood = 'extreme_greed'", 1)),
        "total": "pattern_score * 0.25 + volume_score * 0.25 + position_score * 0.2 + rsi_score * 0.3",
    },
    {"trend": "CASE WHEN bullish > bearish THEN 'up' WHEN bearish > bullish THEN 'down' ELSE 'flat' END", "strength": ladder("total", (70, "strong"), (40, "medium"), rest="weak")},
    out="bullish bearish total:4 trend strength",
)

#: Over dif, dea, hist and its cross, and a divergence: crosses go before trends, trends before divergences.
MACD_RULES = rules({"signal": "CASE WHEN crossed = 'golden' THEN 'buy' WHEN crossed = 'death' THEN 'sell' WHEN dif > dea AND hist > 0 AND dif > 0 THEN 'buy' WHEN dif < dea AND hist < 0 AND dif < 0 THEN 'sell' WHEN diverges = 'bullish' THEN 'buy' WHEN diverges = 'bearish' THEN 'sell' ELSE 'hold' END", "strength": "CASE WHEN crossed IN ('golden', 'death') THEN 'strong' WHEN (hist > 0 AND dif > 0) OR (hist < 0 AND dif < 0) OR diverges <> 'none' THEN 'moderate' ELSE 'weak' END"})
BANDS = {"middle": "ma20", "band": "coalesce(4 * sd / nullif(ma20, 0), 0.0)", "pctb": "coalesce((close - ma20 + 2 * sd) / nullif(4 * sd, 0), 0.5)"}
BOLLINGER_RULES = rules(BANDS, {"signal": "CASE WHEN pctb > 0.8 THEN 'sell' WHEN pctb < 0.2 THEN 'buy' ELSE 'hold' END", "strength": "CASE WHEN pctb > 0.9 OR pctb < 0.1 THEN 'strong' WHEN pctb > 0.8 OR pctb < 0.2 OR band < 0.05 THEN 'moderate' ELSE 'weak' END"})

RSI_STATE = rules(
    {"state": "CASE WHEN rsi14 >= 80 THEN 'overbought' WHEN rsi14 >= 70 THEN 'near_overbought' WHEN rsi14 >= 30 THEN 'neutral' WHEN rsi14 >= 20 THEN 'near_oversold' ELSE 'oversold' END", "strength": "CASE WHEN rsi14 >= 85 OR rsi14 <= 15 THEN 'strong' WHEN rsi14 >= 70 OR rsi14 < 30 THEN 'moderate' ELSE 'neutral' END",
     "cycles": "CASE WHEN rsi14 > 50 AND rsi25 > 50 AND rsi60 > 50 THEN 'strong_up' WHEN rsi14 > 50 AND rsi25 > 50 THEN 'up' WHEN rsi14 > 50 THEN 'slightly_up' WHEN rsi14 < 50 AND rsi25 < 50 AND rsi60 < 50 THEN 'strong_down' WHEN rsi14 < 50 AND rsi25 < 50 THEN 'down' ELSE 'neutral' END"},
)
MULTI_RSI = rules(
    {"mean": "(rsi6 + rsi14 + rsi25 + rsi60) / 4"},
    {"spread": "sqrt((power(rsi6 - mean, 2) + power(rsi14 - mean, 2) + power(rsi25 - mean, 2) + power(rsi60 - mean, 2)) / 4)"},
    {"trend": "CASE WHEN mean > 55 THEN 'up' WHEN mean < 45 THEN 'down' ELSE 'neutral' END", "consensus": "CASE WHEN mean > 50 THEN 'bullish' ELSE 'bearish' END", "divergence": ladder("spread", (10, "high"), (5, "low"), rest="none")},
    out="mean:5 spread:5 trend consensus divergence",
)
#: Over a snapshot with back5, the strength five bars before.
DYNAMIC_RSI = rules(
    {"shift": points(0, ("vol > 0.25", -5), ("vol < 0.1", 5)) + " + CASE WHEN ma5 > ma20 THEN 5 WHEN ma5 < ma20 THEN -5 ELSE 0 END", "speed": "coalesce(rsi14 - back5, 0.0)"},
    {"oversold": "30 + shift", "overbought": "70 + shift"},
    {"signal": "CASE WHEN rsi14 >= overbought THEN 'overbought' WHEN rsi14 >= overbought - 5 THEN 'near_overbought' WHEN rsi14 <= oversold THEN 'oversold' WHEN rsi14 <= oversold + 5 THEN 'near_oversold' ELSE 'neutral' END"},
    {"advice": "CASE WHEN signal = 'oversold' AND speed > 0 THEN 'buy' WHEN signal = 'oversold' THEN 'watch_to_buy' WHEN signal = 'overbought' AND speed < 0 THEN 'reduce' WHEN signal = 'overbought' THEN 'beware' WHEN speed > 3 THEN 'add' WHEN speed < -3 THEN 'trim' ELSE 'hold' END"},
    out="oversold overbought speed:5 signal advice",
)

STATE = {
    "volatility": ladder("turnover", (300, "high"), (200, "medium"), rest="low"), "trend": "CASE WHEN change > 5 THEN 'strong_up' WHEN change > 0 THEN 'up' WHEN change > -5 THEN 'down' ELSE 'sideways' END",
    "momentum": "CASE WHEN turnover > 250 AND change > 3 THEN 'strong' WHEN turnover > 150 THEN 'moderate' ELSE 'weak' END", "trend_strength": ladder("coalesce(atr / nullif(close, 0), 0.0) * 100", (3, "strong"), (2, "moderate"), rest="weak"),
    "position": "coalesce((close - year_low) / nullif(year_high - year_low, 0), 0.5)", "realised": ladder("vol * 100", (40, "high"), (25, "medium"), rest="low"),
}
MARKET_STATE = rules(STATE, out="volatility trend momentum trend_strength position:6 realised")

_ENTRY = {"atr_support": ("atr > 0", 1.2, 0.75), "rsi_oversold": ("rsi14 < 35", 1.3, 0.8), "volume_breakout": ("turnover > 250 AND change > 3", 1.2, 0.75), "ma_support": ("close > ma5 AND close < ma5 * 1.02", 1.0, 0.65), "oversold_bounce": ("change < -8 AND rsi14 < 30", 1.3, 0.7), "resonance": ("rsi14 > 55 AND rsi25 > 55 AND rsi60 > 55", 1.5, 0.85), "trend_following": ("ma5 > ma10 AND ma10 > ma20", 1.0, 0.7)}
ENTRIES = {"entries": named(**{k: v[0] for k, v in _ENTRY.items()}), "entry_count": points(0, *((v[0], 1) for v in _ENTRY.values())), "entry_weight": points(0.0, *((v[0], v[1]) for v in _ENTRY.values())), "entry_confidence": points(0.0, *((v[0], v[2]) for v in _ENTRY.values()))}
ENTRY_SIGNALS = rules(ENTRIES, {"confidence": "CASE WHEN entry_count > 0 THEN entry_confidence / entry_count ELSE 0.5 END"}, out="entries entry_count entry_weight:4 confidence:6")
#: Over a snapshot with the first bar's close and time as cost and entry.
_GAIN = {"gain": "(close / nullif(cost, 0) - 1) * 100"}
EXIT_SIGNALS = rules(
    _GAIN | POSITION,
    {"exits": named(take_profit="atr > 0 AND close > cost + atr * 3.0", stop_loss="atr > 0 AND close < cost - atr * 2.0", time_stop="held > 90", profit_taking="gain > 100 AND change < -5", resistance="to_high > -5 AND change > 0", overextended="gain > 50 AND change > 8")},
    out="gain:5 exits",
)
RECOMMENDED = {"advice": "CASE WHEN gain > 100 AND change < -5 THEN 'hold_reduce' WHEN gain > 100 AND change > 0 THEN 'hold_add' WHEN change < -8 THEN 'buy_dip' ELSE 'hold' END", "value": "close * 100"}
RECOMMENDATION = rules(
    _GAIN | {"risk": "CASE WHEN turnover > 200 THEN 'high' ELSE 'medium' END"},
    RECOMMENDED,
    {"round_trip": "(2 * greatest(value * 0.0003, 5.0) + value * 0.001 + value * 0.0004) / value * 100"},
    {"gross_target": "close * 1.2", "net_target": "close * 1.2 - round_trip / 100 * close"},
    out="advice risk round_trip:5 gross_target:4 net_target:4",
)
TIME_STOP = rules({"stop_price": "close * (1 - 0.02 * held / 90)", "time_signal": "CASE WHEN held > 90 THEN 'triggered' WHEN held > 72 THEN 'approaching' ELSE 'hold' END"}, out="held stop_price:4 time_signal")
COMPOSITE = rules(
    BANDS | {"atr_score": "CASE WHEN ma5 > ma20 THEN 70 WHEN ma5 < ma20 THEN 30 ELSE 50 END", "kelly_score": "greatest(0.05, least(0.25, (0.55 - 0.45 / 2.0) / 2 * greatest(0.5, least(1.5, 1 - 2 * (vol - 0.1))))) * 100 / 0.25", "vol_score": "greatest(0.0, 100 - vol * 200)", "sector_score": "CASE WHEN change > 5 THEN 90 WHEN change > 2 THEN 70 WHEN change > -2 THEN 50 ELSE 30 END"},
    {"band_score": "CASE WHEN pctb < 0.2 THEN 75 WHEN pctb > 0.8 THEN 35 ELSE 50 END"},
    {"composite": "rsi14 * 0.2 + atr_score * 0.2 + kelly_score * 0.15 + vol_score * 0.1 + band_score * 0.2 + sector_score * 0.15"},
    {"advice": "CASE WHEN composite >= 75 THEN 'strong_buy' WHEN composite >= 60 THEN 'buy' WHEN composite >= 45 THEN 'hold' WHEN composite >= 30 THEN 'reduce' ELSE 'sell' END", "confidence": "CASE WHEN composite >= 75 OR composite < 30 THEN 'high' ELSE 'medium' END"},
    out="composite:4 advice confidence",
)
#: Over a snapshot with pe and the industry's mean pe.
SECTOR = rules(
    {"pe_ratio": "coalesce(pe / nullif(industry_pe, 0), 1.0)", "momentum_score": "least(10.0, greatest(0.0, change * 2 + 5))", "volume_score": "least(10.0, greatest(0.0, turnover / 30))"},
    {"pe_score": "greatest(0.0, 10 - abs(pe_ratio - 1) * 5)"},
    {"combined": "pe_score * 0.3 + momentum_score * 0.4 + volume_score * 0.3"},
    {"rating": "CASE WHEN combined >= 8 THEN 'strong' WHEN combined >= 6 THEN 'good' WHEN combined >= 4 THEN 'neutral' ELSE 'watch' END", "sector_trend": "CASE WHEN change > 5 AND turnover > 200 THEN 'strong_up' WHEN change > 2 THEN 'up' WHEN change > -2 THEN 'flat' WHEN change > -5 THEN 'down' ELSE 'strong_down' END", "advice": "CASE WHEN change > 5 AND turnover > 300 THEN 'add' WHEN change < -5 AND turnover > 200 THEN 'buy_dip' WHEN pe_ratio < 0.7 THEN 'buy' WHEN pe_ratio > 1.5 THEN 'dear' ELSE 'fair' END"},
    out="pe_ratio:5 combined:5 rating sector_trend advice",
)
TECHNICAL = rules(
    {"kline": "CASE WHEN change < 0 AND open > close THEN 'false_fall' WHEN change >= 0 THEN 'rise' ELSE 'fall' END", "amplitude": "coalesce((high - low) / nullif(open, 0), 0.0) * 100", "macd": "CASE WHEN change < -5 THEN 'death_soon' WHEN change > 5 THEN 'golden' ELSE 'flat' END", "kdj": "CASE WHEN change < -8 THEN 'oversold' WHEN change > 8 THEN 'overbought' ELSE 'neutral' END", "rsi_guess": "55 + change * 2", "short_term": "CASE WHEN change < -5 THEN 'adjusting' WHEN change > 5 THEN 'rising' ELSE 'swinging' END", "support_1": "close * 0.96", "support_2": "close * 0.88", "support_3": "close * 0.8", "support_4": "close * 0.72", "resistance": "greatest(open, ma20, close * 1.28)"},
    out="kline amplitude:5 macd kdj rsi_guess:5 short_term ma5:5 ma10:5 ma20:5 ma60:5 support_1:4 support_2:4 support_3:4 support_4:4 resistance:4",
)
FUNDAMENTAL = rules({"pe_ratio": "coalesce(pe / nullif(industry_pe, 0), 1.0)"}, {"level": "CASE WHEN pe <= 0 THEN 'loss' WHEN pe_ratio < 0.5 THEN 'very_cheap' WHEN pe_ratio < 0.8 THEN 'cheap' WHEN pe_ratio < 1.2 THEN 'fair' WHEN pe_ratio < 1.5 THEN 'dear' ELSE 'very_dear' END"}, out="pe_ratio:5 level")
SCENARIOS = rules(
    {"month_vol": "ret_sd * sqrt(20.0)", "up_raw": "CASE WHEN ma5 > ma20 THEN 0.4 ELSE 0.3 END", "down_raw": "CASE WHEN rsi14 > 70 THEN 0.35 ELSE 0.25 END"},
    {"total_raw": "up_raw + 0.4 + down_raw", "optimistic": "close * (1 + month_vol * 2)", "neutral": "close * (1 + month_vol * 0.5)", "pessimistic": "greatest(0.0, close * (1 - month_vol * 1.5))"},
    {"expected": "(optimistic * up_raw + neutral * 0.4 + pessimistic * down_raw) / total_raw"},
    {"upside": "(expected / close - 1) * 100"},
    out="month_vol:5 optimistic:4 neutral:4 pessimistic:4 expected:4 upside:4",
)
QUANT = rules({"signals": named(oversold_bounce="change < -5", volume_breakout="turnover > 200", trend_hold="change > 3")}, where="change < -5 OR turnover > 200 OR change > 3")
RULE_ENGINE = rules(
    {"score": points(0.0, ("rsi14 < 30", 0.3), ("rsi14 > 70", -0.3), ("mom5 > mom20", 0.2), ("mom5 < mom20", -0.2), ("ma5 > ma20 * 1.02", 0.15), ("ma5 < ma20 * 0.98", -0.15), ("vol_ratio > 1.5 AND change > 0", 0.05), ("vol_ratio > 1.5 AND change <= 0", -0.05))},
    {"direction": "CASE WHEN score > 0.21 THEN 'bullish' WHEN score < -0.21 THEN 'bearish' ELSE 'neutral' END", "confidence": "least(0.7, abs(score) + 0.3)"},
    out="score:4 direction confidence:4",
)
#: The mean of the worst five in a hundred of a normal law, in deviations.
_TAIL = 2.0627128075074257
KELLY_CVAR = rules(
    {"kelly": "greatest(0.05, least(0.25, (0.55 - 0.45 / 2.0) / 2 * greatest(0.5, least(1.5, 1 - 2 * (vol - 0.1)))))", "cvar": f"greatest(0.0, {_TAIL} * vol / sqrt(252.0) - 0.02)"},
    {"fraction": "CASE WHEN cvar > 0.05 THEN kelly * greatest(0.5, least(1.0, 1 - (cvar - 0.05) * 2)) ELSE kelly END"},
    {"shares": "floor(100000 * fraction / close)", "within": "cvar <= 0.05"},
    out="kelly:6 cvar:6 fraction:6 shares within",
)
TRAILING = rules(
    {"factor": points(1.0, ("held >= 30", -0.05), ("held >= 60", -0.1), ("held >= 90", -0.15))},
    {"trail": "5.0 * (1 + factor)"},
    {"stop": "CASE WHEN close > cost THEN close ELSE cost END * (1 - trail / 100)", "peak_stop": "peak * 0.95"},
    out="factor:4 trail:4 stop:4 peak_stop:4",
)
REGIME = rules({"regime": "CASE WHEN vol < 0.1 THEN 'low' WHEN vol < 0.2 THEN 'normal' WHEN vol < 0.35 THEN 'high' ELSE 'very_high' END", "multiplier": "CASE WHEN vol < 0.1 THEN 1.1 WHEN vol < 0.2 THEN 1.0 WHEN vol < 0.35 THEN 0.85 ELSE 0.7 END"}, out="regime multiplier:4")

#: Over an order: side, value, shares and the day's mean volume.
COST_VARIANTS = rules(
    {"part": "shares / (adv + 1)", "commission": "greatest(value * 0.0003, 5.0)", "stamp": "CASE WHEN side = 'sell' THEN value * 0.001 ELSE 0.0 END"},
    {"impact": "(0.0001 + 0.5 * part) * 1.2 * value", "adaptive": "0.001 * (1 + part) * 1.2 * value", "flat": "value * 5 / 10000"},
    {"linear_total": "commission + stamp + impact + value * 0.001", "flat_total": "2 * commission + value * 0.001 + flat", "net_return": "0.05 - (commission + stamp + impact) / value", "best_shares": "least(adv * power(0.1 / 0.5, 2), adv * 0.1)"},
    {"said": "concat_ws(' ', 'commission', cast(cast(floor(commission * 100 + 0.5) as bigint) as string), 'stamp', cast(cast(floor(stamp * 100 + 0.5) as bigint) as string))"},
    out="commission:4 stamp:4 impact:4 adaptive:4 linear_total:4 flat_total:4 net_return:6 best_shares:4 said",
)

ADX_FACTOR = rules(
    {"direction": "CASE WHEN plus_di > minus_di * 1.1 THEN 'up' WHEN minus_di > plus_di * 1.1 THEN 'down' ELSE 'flat' END", "strength": "CASE WHEN adx > 50 THEN 1.2 WHEN adx > 25 THEN 1.1 WHEN adx > 20 THEN 1.0 WHEN adx > 15 THEN 0.9 ELSE 0.8 END"},
    {"factor": "strength * CASE direction WHEN 'up' THEN 1.1 WHEN 'down' THEN 0.9 ELSE 1.0 END"},
    out="direction factor:4",
)
VERDICT = rules({"returns_said": "CASE WHEN annual > 0.05 THEN 'good' WHEN annual > 0 THEN 'slight' WHEN annual > -0.05 THEN 'small_loss' ELSE 'poor' END", "risk_said": "CASE WHEN -max_dd < 0.05 THEN 'excellent' WHEN -max_dd < 0.15 THEN 'acceptable' ELSE 'large' END", "sharpe_said": ladder("sharpe", (1.0, "excellent"), (0.5, "good"), (0, "fair"), rest="poor"), "win_said": ladder("win_rate", (0.6, "high"), (0.4, "medium"), rest="low")})

FEATURES = {
    "band_width": "coalesce(4 * sd / nullif(ma20, 0), 0.0)", "ma_gap": "coalesce(close / nullif(ma20, 0) - 1, 0.0)", "net_share": "coalesce((outer_vol - inner_vol) / nullif(volume, 0), 0.0)", "outer_inner": _RATIO, "amount_level": "ln(1 + amount)",
    "volume_turnover": "coalesce(volume / nullif(turnover, 0), 0.0)", "down_share": "coalesce(down / nullif(ret_sd, 0), 0.0)", "range_proxy": "coalesce((high - low) / nullif(high + low, 0), 0.0)", "rsi_gap": "(rsi14 - 50) / 50", "atr_share": "coalesce(atr / nullif(close, 0), 0.0)",
}
WIDTHS = rules({k: FEATURES[k] for k in ("band_width", "ma_gap")}, out="band_width:6 ma_gap:6")
RATIOS = rules({k: FEATURES[k] for k in ("net_share", "outer_inner", "amount_level", "volume_turnover")}, out="net_share:6 outer_inner:6 amount_level:6 volume_turnover:6")
ALL_FEATURES = rules({k: f"coalesce({v}, 0.0)" for k, v in FEATURES.items()} | {"f_mom5": "mom5", "f_mom20": "mom20", "f_vol": "vol", "f_turnover": "turnover / 100", "f_vol_ratio": "vol_ratio"}, out=" ".join(f"{k}:6" for k in (*FEATURES, "f_mom5", "f_mom20", "f_vol", "f_turnover", "f_vol_ratio")))
TECHNICAL_MOOD = rules(
    {"score": "least(1.0, greatest(-1.0, least(0.3, greatest(-0.3, mom5 * 5)) + CASE WHEN ma5 > ma20 THEN 0.2 ELSE -0.2 END + CASE WHEN rsi < 30 THEN 0.15 WHEN rsi > 70 THEN -0.15 ELSE 0.0 END + CASE WHEN volume5 / mean_volume > 1.5 THEN 0.15 WHEN volume5 / mean_volume < 0.5 THEN -0.1 ELSE 0.0 END))"},
    {"level": ladder("score", (0.401, "strong_bullish"), (0.101, "bullish"), (-0.099, "neutral"), (-0.399, "bearish"), rest="strong_bearish"), "reasons": named(strong="mom5 > 0.03", weak="mom5 < -0.03", above="ma5 > ma20", below="ma5 <= ma20")},
    out="score:5 level reasons",
)
IMPLIED = rules({"historical": "vol", "implied": "coalesce(atr / nullif(close, 0), 0.0) * sqrt(252.0)", "ma_momentum": "coalesce((close - ma20) / nullif(ma20, 0), 0.0)"}, out="historical:6 implied:6 ma_momentum:6")
STRATEGY = rules({"signal": "CASE WHEN rsi14 < 35 AND mom5 > 0 THEN 'buy' WHEN rsi14 > 65 AND mom5 < 0 THEN 'sell' ELSE 'hold' END"})
MODAL = rules(
    {"one": "least(1.0, greatest(0.0, rsi14 / 100))", "two": "least(1.0, greatest(0.0, 0.5 + mom5))", "three": "least(1.0, turnover / 200)"},
    {"mean": "(one + two + three) / 3"},
    {"score": "0.6 * mean + 0.4 * (1 - sqrt((power(one - mean, 2) + power(two - mean, 2) + power(three - mean, 2)) / 3))"},
    {"direction": ladder("0.6 * score + 0.4 * mean", (0.6, "up"), (0.4, "flat"), rest="down")},
    out="score:6 direction",
)
TREND_OF_VOL = rules({"trend": "CASE WHEN recent > earlier * 1.1 THEN 'rising' WHEN recent < earlier * 0.9 THEN 'falling' ELSE 'stable' END"}, out="recent:6 earlier:6 trend")

MARKED = rules({"unrealised": "(close - cost) * 100", "unrealised_share": "coalesce(close / nullif(cost, 0) - 1, 0.0)", "sellable": "CASE WHEN held > 0 THEN 100 ELSE 0 END"}, out="unrealised:4 unrealised_share:6 sellable")
FLOW_SPLIT = rules({"buy": "coalesce(outer_vol / nullif(volume, 0), 0.5)"}, {"large": "amount * (0.1 + 0.3 * buy)", "medium": "amount * 0.3", "small": "amount * (0.6 - 0.3 * buy)", "leaning": "CASE WHEN buy > 0.6 THEN 'buy' WHEN buy < 0.4 THEN 'sell' ELSE 'even' END"}, out="buy:6 large:3 medium:3 small:3 leaning")
CLASSES = rules({"z": "CASE WHEN sd > 1e-10 THEN least(5.0, greatest(-5.0, (close - ma20) / sd)) ELSE 0.0 END"}, {"label": "CASE WHEN z / 5 > 0.33 THEN 1 WHEN z / 5 < -0.33 THEN -1 ELSE 0 END"}, out="z:5 label")
#: Probabilities of up, flat and down from three models, weighed by the regime.
ENSEMBLE = rules(
    {"up_a": "least(0.9, greatest(0.1, 0.5 + mom5))", "up_b": "least(0.9, greatest(0.1, 1 - rsi14 / 100))", "up_c": "CASE WHEN ma5 > ma20 THEN 0.6 ELSE 0.4 END", "weight": "CASE WHEN vol > 0.35 THEN 0.2 WHEN ma5 > ma20 THEN 0.5 ELSE 0.35 END"},
    {"p_up": "up_a * weight + up_b * (1 - weight) / 2 + up_c * (1 - weight) / 2"},
    {"p_down": "(1 - p_up) * 0.7", "p_flat": "(1 - p_up) * 0.3"},
    {"direction": "CASE WHEN p_up > 0.4 AND p_up > p_down THEN 'up' WHEN p_down > 0.4 AND p_down >= p_up THEN 'down' ELSE 'flat' END", "sure": "greatest(p_up, p_down, p_flat)"},
    out="p_up:6 p_down:6 p_flat:6 direction sure:6",
)
REGIME_VECTOR = rules({"trend_gap": "coalesce(ma5 / nullif(ma20, 0) - 1, 0.0)", "long_gap": "coalesce(ma20 / nullif(ma60, 0) - 1, 0.0)"}, {"regime": "CASE WHEN vol > 0.6 THEN 'volatile' WHEN trend_gap > 0.02 AND long_gap > 0 THEN 'bull' WHEN trend_gap < -0.02 AND long_gap < 0 THEN 'bear' ELSE 'sideways' END"}, out="ret_mean:6 vol:6 mom20:6 trend_gap:6 long_gap:6 vol_ratio:5 regime")
GARCH_STATE = rules({"annual": "CASE WHEN place < 20 THEN 0.2 ELSE sqrt(variance * 52) END"}, {"state": "CASE WHEN annual < 0.1 THEN 'low' WHEN annual < 0.2 THEN 'normal' WHEN annual < 0.35 THEN 'high' ELSE 'very_high' END", "multiplier": "CASE WHEN annual < 0.1 THEN 1.1 WHEN annual < 0.2 THEN 1.0 WHEN annual < 0.35 THEN 0.85 ELSE 0.7 END"}, out="annual:5 state multiplier:4")
