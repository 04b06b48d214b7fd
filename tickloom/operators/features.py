"""Causal features of bar series. Every value at a bar uses that bar and earlier ones only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import clip, log_ratio, ratio, ratio_or_zero
from . import recurrence as R

BASE = (
    "return_1", "return_5", "roc_5", "roc_12", "log_return_1", "range_pct", "body_pct", "upper_wick_pct", "lower_wick_pct", "sma_20", "sma_50", "ema_20", "ema_50",
    "atr_14", "atr_pct", "rsi_14", "rolling_vol_20", "bollinger_z_20", "distance_ema20_atr", "range_atr", "trend_ema20_above_ema50", "breakout_up_20", "breakout_down_20",
    "minute_of_session", "minutes_to_session_close", "day_of_week",
)


def _full(n: int, w) -> Column:
    return F.row_number().over(w) >= n


def framed(f, n: int, w, skip: int = 0) -> Column:
    """``f`` over the last ``n`` rows (without the newest ``skip``), null until the frame is full."""
    return F.when(F.row_number().over(w) >= n + skip, f.over(w.rowsBetween(-(n - 1) - skip, -skip)))


def windowed(bars: DataFrame, by: list[str], order: str = "opens_at", session: str = "session_date") -> DataFrame:
    """Adds the features of ``BASE`` that fixed frames give, and gap (same session, but not right behind the previous bar).

    Needs open, high, low, close, closes_at, and session_date, session_opens,
    session_closes of the session. Nulls while a feature warms up.
    """
    w = W.partitionBy(*by).orderBy(order)
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    back = lambda k: ratio(c, F.lag("close", k).over(w)) - 1
    rows = bars.select(
        "*", back(1).alias("return_1"), back(5).alias("return_5"), back(5).alias("roc_5"), back(12).alias("roc_12"), log_ratio(c, F.lag("close").over(w)).alias("log_return_1"),
        ratio(h - low, c).alias("range_pct"), ratio(c - o, o).alias("body_pct"), ratio(h - F.greatest(o, c), o).alias("upper_wick_pct"), ratio(F.least(o, c) - low, o).alias("lower_wick_pct"),
        framed(F.avg("close"), 20, w).alias("sma_20"), framed(F.avg("close"), 50, w).alias("sma_50"), framed(F.stddev_pop("close"), 20, w).alias("_sd"),
        (c > framed(F.max("high"), 20, w, 1)).alias("breakout_up_20"), (c < framed(F.min("low"), 20, w, 1)).alias("breakout_down_20"),
        ((F.lag(session).over(w) == F.col(session)) & (F.lag("closes_at").over(w) != F.col(order))).alias("gap"),
        ((F.unix_timestamp(F.col(order).cast("timestamp")) - F.unix_timestamp("session_opens")) / 60).alias("minute_of_session"),
        ((F.unix_timestamp("session_closes") - F.unix_timestamp(F.col("closes_at").cast("timestamp"))) / 60).alias("minutes_to_session_close"), F.weekday(session).alias("day_of_week"),
    )
    rows = rows.withColumn("rolling_vol_20", F.when(_full(21, w), F.stddev_pop("return_1").over(w.rowsBetween(-19, 0))))
    return rows.withColumn("bollinger_z_20", ratio(c - F.col("sma_20"), F.when(F.col("_sd") > 1e-12, F.col("_sd")))).drop("_sd")


def base(bars: DataFrame, by: list[str], order: str = "opens_at", session: str = "session_date") -> DataFrame:
    """Adds all of ``BASE``: ``windowed`` and the recursive means."""
    h, low, c = (F.col(x) for x in ("high", "low", "close"))
    rows = windowed(bars, by, order, session)
    for n in (20, 50):
        rows = R.ema(rows, F.col("close"), n, by, order, f"ema_{n}")
    rows = R.rsi(R.atr(rows, 14, by, order, "atr_14"), "close", 14, by, order, "rsi_14")
    return rows.select(
        "*", ratio(F.col("atr_14"), c).alias("atr_pct"), ratio(c - F.col("ema_20"), F.col("atr_14")).alias("distance_ema20_atr"), ratio(h - low, F.col("atr_14")).alias("range_atr"),
        (F.col("ema_20") > F.col("ema_50")).alias("trend_ema20_above_ema50"),
    )


def readiness(rows: DataFrame, by: list[str], order: str = "opens_at", history: int = 50, needed: tuple[str, ...] = BASE) -> DataFrame:
    """Adds blockers: too few bars, a gap in the last ``history`` bars, a feature that is still null."""
    w = W.partitionBy(*by).orderBy(order)
    n = F.row_number().over(w)
    gap = F.max(F.coalesce("gap", F.lit(False)).cast("int")).over(w.rowsBetween(-(history - 1), 0)) == 1
    null = F.lit(False)
    for c in needed:
        null |= F.col(c).isNull()
    short = F.when(n < history, F.concat(F.lit("INSUFFICIENT_HISTORY:"), n.cast("string"), F.lit(f"/{history}")))
    return rows.withColumn("blockers", F.array_compact(F.array(short, F.when(gap, F.lit("INTRADAY_GAP_IN_FEATURE_WINDOW")), F.when(null, F.lit("FEATURE_WARMUP_INCOMPLETE")))))


def prefixed(rows: DataFrame, columns: list[str], prefix: str, keep: list[str]) -> DataFrame:
    return rows.select(*keep, *[F.col(c).alias(f"{prefix}__{c}") for c in columns])


FRAMES = ("primary_5m", "context_15m", "context_1h")


def _sign(x: Column, dead: float = 0.0) -> Column:
    return F.when(x > dead, F.lit(1.0)).when(x < -dead, F.lit(-1.0)).otherwise(F.lit(0.0))


def _mean(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0]) / len(columns)


def enhanced(rows: DataFrame) -> DataFrame:
    """Adds 22 combinations (enhanced__*) of three frames' base features (``prefixed`` by ``FRAMES``).

    Flags of trend count as 1 or -1, signs as 1, -1 or 0; ratios are 0 where the divisor is next to 0 and clipped to [0, 10];
    session progress is the minute's share of the minutes gone and left.
    """
    p, q, r = FRAMES
    c = lambda frame, name: F.col(f"{frame}__{name}").cast("double")
    share = lambda name, a, b: clip(ratio_or_zero(c(a, name), c(b, name)), 0.0, 10.0)
    trend = {x: ratio_or_zero(c(x, "ema_20") - c(x, "ema_50"), c(x, "atr_14")) for x in FRAMES}
    rsi = {x: (c(x, "rsi_14") - 50) / 50 for x in FRAMES}
    minute, left = F.greatest(c(p, "minute_of_session"), F.lit(0.0)), F.greatest(c(p, "minutes_to_session_close"), F.lit(0.0))
    rows = rows.withColumns({
        "enhanced__trend_alignment": _mean([F.when(c(x, "trend_ema20_above_ema50") >= 0.5, 1.0).otherwise(-1.0) for x in FRAMES]),
        "enhanced__momentum_alignment": _mean([_sign(c(x, "roc_5")) for x in FRAMES]),
        "enhanced__session_progress": F.when(minute + left > 0, minute / (minute + left)).otherwise(F.lit(0.0)),
    })
    progress, align = F.col("enhanced__session_progress"), F.col("enhanced__trend_alignment")
    return rows.withColumns({f"enhanced__{name}": value for name, value in {
        "trend_strength_5m": trend[p], "trend_strength_15m": trend[q], "trend_strength_1h": trend[r],
        "breakout_vote": _mean([c(x, "breakout_up_20") - c(x, "breakout_down_20") for x in FRAMES]),
        "rsi_centered_5m": rsi[p], "rsi_centered_15m": rsi[q], "rsi_centered_1h": rsi[r], "rsi_5m_minus_1h": (rsi[p] - rsi[r]) / 2,
        "atr_pct_5m_to_15m": share("atr_pct", p, q), "atr_pct_15m_to_1h": share("atr_pct", q, r),
        "volatility_5m_to_15m": share("rolling_vol_20", p, q), "range_expansion_5m_vs_15m": share("range_atr", p, q),
        "ema_distance_concordance": _mean([_sign(c(x, "distance_ema20_atr")) for x in FRAMES]),
        "wick_imbalance_5m": c(p, "lower_wick_pct") - c(p, "upper_wick_pct"),
        "body_momentum_concordance_5m": _mean([_sign(c(p, x)) for x in ("body_pct", "return_1", "roc_5")]),
        "session_progress_sin": F.sin(progress * math.pi), "session_progress_cos": F.cos(progress * math.pi),
        "trend_momentum_interaction": align * F.col("enhanced__momentum_alignment"), "volatility_trend_interaction": c(p, "atr_pct") * trend[p],
    }.items()})


#: The 27 features of ``research``.
RESEARCH = (
    "macd_line_atr", "macd_signal_atr", "macd_histogram_atr", "adx_14", "di_spread", "slope_10_atr", "slope_20_atr",
    "support_distance_20_atr", "resistance_distance_20_atr", "support_distance_50_atr", "resistance_distance_50_atr",
    "session_return_atr", "opening_gap_atr", "opening_range_ready", "opening_range_position",
    "previous_high_distance_atr", "previous_low_distance_atr", "previous_close_distance_atr",
    "doji", "hammer", "shooting_star", "bullish_engulfing", "bearish_engulfing", "inside_bar", "outside_bar",
    "three_bar_return_atr", "consecutive_direction",
)


def research(bars: DataFrame, by: list[str], order: str = "opens_at", session: str = "session_date") -> DataFrame:
    """Adds the features of ``RESEARCH`` (research_v3__*) to bars with atr_14; distances are in ranges (atr_14), flags 0 or 1.

    The first session of a series takes its own open for the session before it.
    """
    w = W.partitionBy(*by).orderBy(order)
    rows = R.adx(R.macd_parts(daily_state(bars, by, session, order), by, order), 14, by, order, "_adx", "_spread")
    o, h, low, c, a = (F.col(x) for x in ("open", "high", "low", "close", "atr_14"))
    rows = rows.withColumn("_n", F.row_number().over(w).cast("double"))
    for x in ("open", "high", "low", "close"):
        rows = rows.withColumn(f"_{x}", F.lag(x).over(w))
    first = F.first(F.struct("open", session)).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_f", first)
    start = F.when(F.col("_f")[session] == F.col(session), F.col("_f")["open"])
    unit = F.greatest(a, F.lit(1e-12))
    span, body, before = F.greatest(h - low, F.lit(1e-12)), c - o, F.col("_close") - F.col("_open")
    upper, lower, small = h - F.greatest(o, c), F.least(o, c) - low, F.greatest(F.abs(body), F.greatest(h - low, F.lit(1e-12)) * 0.05)
    past = lambda n: w.rowsBetween(-n, -1)
    slope = lambda n: F.when(F.col("_n") >= n, F.regr_slope("close", "_n").over(w.rowsBetween(1 - n, 0))).otherwise(F.lit(0.0))
    same = [F.lag(_sign(body), k).over(w) == _sign(body) for k in range(1, 6)]
    run = F.lit(1)
    for equal in reversed(same):
        run = F.when(equal, run + 1).otherwise(F.lit(1))
    position = F.when(F.col("opening_ready"), (c - F.col("opening_low")) / F.greatest(F.col("opening_high") - F.col("opening_low"), F.lit(1e-12))).otherwise(F.lit(0.5))
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    values = {
        "macd_line_atr": F.col("macd_line") / unit, "macd_signal_atr": F.col("macd_signal") / unit, "macd_histogram_atr": (F.col("macd_line") - F.col("macd_signal")) / unit,
        "adx_14": F.col("_adx"), "di_spread": F.col("_spread"), "slope_10_atr": slope(10) / unit, "slope_20_atr": slope(20) / unit,
        **{f"support_distance_{n}_atr": (c - F.coalesce(F.min("low").over(past(n)), low)) / unit for n in (20, 50)},
        **{f"resistance_distance_{n}_atr": (F.coalesce(F.max("high").over(past(n)), h) - c) / unit for n in (20, 50)},
        "session_return_atr": (c - F.col("session_open")) / unit, "opening_gap_atr": (F.col("session_open") - F.coalesce(start, "previous_close")) / unit,
        "opening_range_ready": flag(F.col("opening_ready")), "opening_range_position": clip(position, -2.0, 3.0),
        "previous_high_distance_atr": (F.coalesce(start, "previous_high") - c) / unit, "previous_low_distance_atr": (c - F.coalesce(start, "previous_low")) / unit,
        "previous_close_distance_atr": (c - F.coalesce(start, "previous_close")) / unit,
        "doji": flag(F.abs(body) / span <= 0.10), "hammer": flag((lower >= 2 * small) & (upper <= F.abs(body))), "shooting_star": flag((upper >= 2 * small) & (lower <= F.abs(body))),
        "bullish_engulfing": flag((before < 0) & (body > 0) & (o <= F.col("_close")) & (c >= F.col("_open"))),
        "bearish_engulfing": flag((before > 0) & (body < 0) & (o >= F.col("_close")) & (c <= F.col("_open"))),
        "inside_bar": flag((h <= F.col("_high")) & (low >= F.col("_low"))), "outside_bar": flag((h >= F.col("_high")) & (low <= F.col("_low"))),
        "three_bar_return_atr": F.coalesce((c - F.lag("close", 3).over(w)) / unit, F.lit(0.0)), "consecutive_direction": _sign(body) * run,
    }
    own = [x for x in bars.columns]
    return rows.select(*own, *[values[n].cast("double").alias(f"research_v3__{n}") for n in RESEARCH])


#: The 12 features of ``structural``.
STRUCTURAL = (
    "confirmed_swing_high_distance_atr", "confirmed_swing_low_distance_atr", "swing_high_progression_atr", "swing_low_progression_atr", "structure_score",
    "break_of_structure_up", "break_of_structure_down", "swing_low_liquidity_sweep", "swing_high_liquidity_sweep",
    "range_compression_3_to_12", "close_location", "body_efficiency",
)


def structural(bars: DataFrame, by: list[str], order: str = "opens_at") -> DataFrame:
    """Adds the features of ``STRUCTURAL`` (price_action__*): confirmed swings in simple means of 14 true ranges, 0 where there is no swing yet."""
    w = W.partitionBy(*by).orderBy(order)
    rows = pivots(bars.withColumn("_tr", R.true_range(by, order)), by, order)
    rows = rows.withColumn("_atr", F.greatest(F.avg("_tr").over(w.rowsBetween(-13, 0)), F.lit(1e-12))).withColumn("_span", F.col("high") - F.col("low"))
    a, h, low, c = F.col("_atr"), F.col("high"), F.col("low"), F.col("close")
    h1, h2, l1, l2 = (F.col(f"pivot_{x}") for x in ("high_1", "high_2", "low_1", "low_2"))
    up, down = F.coalesce((h1 - h2) / a, F.lit(0.0)), F.coalesce((l1 - l2) / a, F.lit(0.0))
    span = F.greatest(F.col("_span"), F.lit(1e-12))
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    mean = lambda n: F.avg("_span").over(w.rowsBetween(1 - n, 0))
    values = (
        F.coalesce((c - h1) / a, F.lit(0.0)), F.coalesce((c - l1) / a, F.lit(0.0)), up, down,
        F.when((up > 0) & (down > 0), 1.0).when((up < 0) & (down < 0), -1.0).otherwise(0.0), flag(c > h1 + 0.05 * a), flag(c < l1 - 0.05 * a),
        flag((low < l1) & (l1 < c)), flag((h > h1) & (h1 > c)), mean(3) / F.greatest(mean(12), F.lit(1e-12)), (c - low) / span, (c - F.col("open")) / span,
    )
    return rows.select(*bars.columns, *[v.alias(f"price_action__{n}") for n, v in zip(STRUCTURAL, values)])


def structure(bars: DataFrame, by: list[str], order: str = "opens_at") -> DataFrame:
    """Adds slope, support and resistance, run length, patterns, MACD and ADX of a series (needs atr_14)."""
    w = W.partitionBy(*by).orderBy(order)
    o, h, low, c, a = (F.col(x) for x in ("open", "high", "low", "close", "atr_14"))
    rows = bars.withColumn("_n", F.row_number().over(w).cast("double"))
    prev = {x: F.lag(x).over(w) for x in ("open", "high", "low", "close")}
    body, span = F.abs(c - o), h - low
    rows = rows.withColumn("_s", F.signum(c - o))
    sign = F.col("_s")
    rows = rows.select("*", *[(F.lag("_s", k).over(w) == sign).alias(f"_s{k}") for k in range(1, 6)])
    run = F.lit(1)
    for k in range(5, 0, -1):
        run = F.when(F.col(f"_s{k}"), run + 1).otherwise(F.lit(1))
    upper, lower = h - F.greatest(o, c), F.least(o, c) - low
    frame = lambda n: w.rowsBetween(-n, -1)
    rows = rows.select(
        "*", F.when(F.col("_n") >= 10, ratio(F.regr_slope("close", "_n").over(w.rowsBetween(-9, 0)), a)).alias("slope_10_atr"),
        *[ratio(c - F.coalesce(F.min("low").over(frame(n)), low), a).alias(f"support_{n}_atr") for n in (20, 50)],
        *[ratio(F.coalesce(F.max("high").over(frame(n)), h) - c, a).alias(f"resistance_{n}_atr") for n in (20, 50)],
        (body <= 0.10 * span).alias("doji"), ((lower >= 2 * body) & (upper <= body)).alias("hammer"), ((upper >= 2 * body) & (lower <= body)).alias("shooting_star"),
        ((c > o) & (prev["close"] < prev["open"]) & (c >= prev["open"]) & (o <= prev["close"])).alias("bullish_engulfing"),
        ((c < o) & (prev["close"] > prev["open"]) & (c <= prev["open"]) & (o >= prev["close"])).alias("bearish_engulfing"),
        ((h < prev["high"]) & (low > prev["low"])).alias("inside_bar"), ((h > prev["high"]) & (low < prev["low"])).alias("outside_bar"),
        F.when(sign == 0, F.lit(0.0)).otherwise(sign * run).alias("consecutive_direction"), ratio(c - F.lag("close", 3).over(w), a).alias("three_bar_return_atr"),
        ratio(c - low, h - low).alias("close_location"), ratio(body, span).alias("body_efficiency"),
        ratio(F.avg(span).over(w.rowsBetween(-2, 0)), F.avg(span).over(w.rowsBetween(-11, 0))).alias("range_compression"),
    ).drop("_n", "_s", *[f"_s{k}" for k in range(1, 6)])
    return R.adx(R.macd(rows, by, order), 14, by, order).withColumn("macd_atr", ratio("macd", "atr_14")).drop("macd")


def daily_state(bars: DataFrame, by: list[str], session: str = "session_date", order: str = "opens_at", opening: int = 6) -> DataFrame:
    """Adds the session's open, gap from the previous session's close (its own open on the first), opening range (growing over ``opening`` bars), and the previous session's extremes."""
    day = W.partitionBy(*by, session).orderBy(order)
    days = bars.groupBy(*by, session).agg(F.max("high").alias("_h"), F.min("low").alias("_l"), F.max_by("close", order).alias("_c"))
    over = W.partitionBy(*by).orderBy(session)
    days = days.select(*by, session, F.lag("_h").over(over).alias("previous_high"), F.lag("_l").over(over).alias("previous_low"), F.lag("_c").over(over).alias("previous_close"))
    rows = bars.withColumn("position", F.row_number().over(day) - 1).withColumn("session_open", F.first("open").over(day.rowsBetween(W.unboundedPreceding, 0)))
    early = F.col("position") < opening
    rows = rows.withColumn("opening_high", F.max(F.when(early, F.col("high"))).over(day)).withColumn("opening_low", F.min(F.when(early, F.col("low"))).over(day))
    rows = rows.withColumn("opening_ready", F.col("position") >= opening - 1).join(days, [*by, session], "left")
    return rows.withColumn("opening_gap", ratio(F.col("session_open"), F.coalesce("previous_close", "session_open")) - 1)


def pivots(bars: DataFrame, by: list[str], order: str = "opens_at", width: int = 2, lookback: int = 80) -> DataFrame:
    """Adds the last two confirmed pivot highs and lows (``width`` strictly lower or higher bars on each side), known ``width`` bars later, from the last ``lookback`` bars."""
    w = W.partitionBy(*by).orderBy(order)
    around = [k for k in range(-width, width + 1) if k]
    at = lambda c, k: F.lag(c, width - k).over(w)
    high = F.lit(True)
    low = F.lit(True)
    for k in around:
        high &= at("high", 0) > at("high", k) if k < width else at("high", 0) > F.col("high")
        low &= at("low", 0) < at("low", k) if k < width else at("low", 0) < F.col("low")
    rows = bars.withColumn("_ph", F.when(high, at("high", 0))).withColumn("_pl", F.when(low, at("low", 0)))
    frame = w.rowsBetween(-(lookback - width), 0)
    for name, c in (("high", "_ph"), ("low", "_pl")):
        found = F.collect_list(c).over(frame)
        rows = rows.withColumn("_f", found).withColumn(f"pivot_{name}_1", F.try_element_at("_f", F.lit(-1))).withColumn(f"pivot_{name}_2", F.try_element_at("_f", F.lit(-2))).drop("_f")
    rows = rows.drop("_ph", "_pl")
    h1, h2, l1, l2 = (F.col(f"pivot_{x}") for x in ("high_1", "high_2", "low_1", "low_2"))
    known = h2.isNotNull() & l2.isNotNull()
    return rows.withColumn("structure", F.when(~known, F.lit("UNAVAILABLE")).when((h1 > h2) & (l1 > l2), F.lit("BULLISH")).when((h1 < h2) & (l1 < l2), F.lit("BEARISH")).otherwise(F.lit("TRANSITION")))


def context(bars: DataFrame, by: list[str], order: str = "opens_at") -> DataFrame:
    """12 features of a context series: returns, range, close location, volatilities, mean spreads (seeded by the first value), a simple-sum RSI, and the return's z-score."""
    w = W.partitionBy(*by).orderBy(order)
    c = F.col("close")
    back = lambda k: F.coalesce(ratio(c, F.lag("close", k).over(w)) - 1, F.lit(0.0))
    rows = bars.withColumn("context_return_1", back(1)).withColumn("_d", F.coalesce(c - F.lag("close").over(w), F.lit(0.0)))
    for n in (8, 20, 21, 50):
        rows = R.ema(rows, c, n, by, order, f"_e{n}", seed=1)
    rows = rows.withColumn("_tr", R.true_range(by, order))
    atr = F.avg("_tr").over(w.rowsBetween(-13, 0))
    gain, loss = (F.sum(F.greatest(s * F.col("_d"), F.lit(0.0))).over(w.rowsBetween(-13, 0)) for s in (1, -1))
    vol = lambda n: F.stddev_pop("context_return_1").over(w.rowsBetween(-(n - 1), 0))
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    mean48 = F.avg("context_return_1").over(w.rowsBetween(-47, 0))
    rows = rows.select(
        "*", back(3).alias("context_return_3"), back(12).alias("context_return_12"), (span / F.greatest(c, F.lit(1e-12))).alias("context_range_pct"),
        ((c - F.col("low")) / span).alias("context_close_location"), ratio_or_zero(atr, c).alias("context_atr_pct"),
        vol(12).alias("context_vol_12"), vol(48).alias("context_vol_48"), ratio_or_zero(F.col("_e8") - F.col("_e21"), atr).alias("context_ema_8_21_atr"),
        ratio_or_zero(F.col("_e20") - F.col("_e50"), atr).alias("context_ema_20_50_atr"), _sign(F.col("_e8") - F.col("_e21"), 1e-12).alias("context_trend"), F.coalesce(ratio(gain, gain + loss), F.lit(0.5)).alias("context_rsi"),
        ratio_or_zero(F.col("context_return_1") - mean48, vol(48)).alias("context_return_z48"),
    )
    return rows.drop("_d", "_e8", "_e20", "_e21", "_e50", "_tr")


def cross(rows: DataFrame, bank: str, vix: str, main: str) -> DataFrame:
    """Adds six features of two context series beside the main one (columns of ``context``, prefixed ``bank``__, ``vix``__ and ``main``__)."""
    b, v, m = ((lambda n, x=x: F.col(f"{x}__context_{n}")) for x in (bank, vix, main))
    return rows.select(
        "*", (b("return_1") - m("return_1")).alias("cross__bank_minus_main_return_1"), (b("return_3") - m("return_3")).alias("cross__bank_minus_main_return_3"),
        (_sign(b("ema_8_21_atr"), 1e-12) * m("trend")).alias("cross__bank_main_trend_agreement"), (v("return_1") * m("return_1")).alias("cross__vix_return_times_main_return"),
        F.abs(v("return_z48")).alias("cross__vix_shock_abs"), (-v("return_z48") - m("trend")).alias("cross__risk_off_score"),
    )


def changes(rows: DataFrame, by: list[str], order: str, contract: str, session: str, values: list[str], minutes: int = 15) -> DataFrame:
    """Adds comparable (a previous row of the same session and contract, at most ``minutes`` ago) and <value>_change, null where it is not."""
    w = W.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("comparable", _comparable(w, order, contract, session, minutes))
    return rows.withColumns({f"{v}_change": F.when(F.col("comparable"), F.col(v) - F.lag(v).over(w)) for v in values})


def _comparable(w, order: str, contract: str, session: str, minutes: int) -> Column:
    seconds = (F.unix_micros(F.col(order).cast("timestamp")) - F.unix_micros(F.lag(order).over(w).cast("timestamp"))) / 1e6
    usable = F.lag(contract).over(w).eqNullSafe(F.col(contract)) & (F.lag(session).over(w) == F.col(session)) & (seconds > 0) & (seconds <= 60 * minutes)
    return F.coalesce(usable, F.lit(False))


#: The 15 features of ``derivatives``; the first eight are its core.
DERIVATIVES = (
    "spot_return_1", "futures_return_1", "basis_bps", "basis_change_bps", "volume_delta_log1p", "open_interest_change_pct", "book_imbalance", "book_imbalance_change",
    "provider_pcr", "provider_pcr_change", "atm_iv", "atm_iv_change", "delta25_iv_skew", "delta25_iv_skew_change", "option_volume_pcr",
)


def derivatives(snapshots: DataFrame, by: list[str], order: str = "observed_at", minutes: int = 15) -> DataFrame:
    """Adds the features of ``DERIVATIVES`` (derivatives__*), comparable, complete_core and options_complete.

    Needs the numbers of a snapshot, futures_symbol, session_date and regular (within trading hours). Returns need a
    positive previous value; volume counts as log(1 + its growth), no growth as 0. What compares with
    the previous snapshot is null across sessions, contracts and gaps. Values that are not finite count as null.
    """
    w = W.partitionBy(*by).orderBy(order)
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    value = lambda name: number(F.col(name).cast("double"))
    usable = _comparable(w, order, "futures_symbol", "session_date", minutes)
    before = lambda name: F.when(usable, F.lag(value(name)).over(w))
    back = lambda name: F.when(before(name) > 0, value(name) / before(name) - 1)
    grown = lambda name: value(name) - before(name)
    volume = F.log1p(F.greatest(grown("futures_volume"), F.when(grown("futures_volume").isNotNull(), F.lit(0.0))))
    values = (
        back("spot_ltp"), back("futures_ltp"), value("futures_basis_bps"), grown("futures_basis_bps"), volume, back("futures_open_interest"),
        value("futures_book_imbalance"), grown("futures_book_imbalance"), value("provider_put_call_ratio"), grown("provider_put_call_ratio"),
        value("atm_implied_volatility"), grown("atm_implied_volatility"), value("delta25_put_call_iv_skew"), grown("delta25_put_call_iv_skew"), value("option_volume_put_call_ratio"),
    )
    names = [f"derivatives__{n}" for n in DERIVATIVES]
    rows = snapshots.select("*", usable.alias("comparable"), *[v.alias(n) for n, v in zip(names, values)])
    whole = lambda own: F.forall(F.array(*own), lambda x: x.isNotNull())
    return rows.withColumn("complete_core", F.col("regular") & F.col("comparable") & whole(names[:8])).withColumn("options_complete", F.col("regular") & whole(names[8:]))
