"""Market structure: swings, levels, evidence, setups and plans at every bar of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import codes, pinned

#: Weights of evidence (trends of the three frames from fine to coarse), score limits of grades and bias.
WEIGHTS = {"trend_5m": 12, "trend_15m": 16, "trend_1h": 20, "structure": 18, "break": 22, "sweep": 14, "opening_range": 12, "previous_session": 12, "expansion": 8}
PATTERN_WEIGHTS = {"BULLISH_ENGULFING": 8, "HAMMER_REJECTION": 6, "BEARISH_ENGULFING": -8, "SHOOTING_STAR_REJECTION": -6}
GRADES = ((70, "STRONG"), (45, "MODERATE"), (25, "WEAK"))
BIAS, TRIGGER, WATCH = 25, 55, 35
#: Least bars of the finest and of the other frames; limits in ranges (atr); targets in risks.
PRIMARY_BARS, CONTEXT_BARS = 50, 20
BUFFER, NEAR_PIVOT, CLUSTER, LEAST_RISK, MOST_RISK = 0.05, 0.35, 0.18, 0.65, 1.50
TARGETS, EXPIRY_BARS = (1.25, 2.0, 3.0), 12


def trend(close: Column, fast: Column, slow: Column, n: Column) -> Column:
    """BULLISH or BEARISH by the order of close and means (the fast one alone while the slow is null), else MIXED; UNAVAILABLE below 20 bars."""
    up = F.when(slow.isNull(), close > fast).otherwise((close > fast) & (fast > slow))
    down = F.when(slow.isNull(), close < fast).otherwise((close < fast) & (fast < slow))
    return F.when((n < CONTEXT_BARS) | fast.isNull(), F.lit("UNAVAILABLE")).when(up, F.lit("BULLISH")).when(down, F.lit("BEARISH")).otherwise(F.lit("MIXED"))


def swings(bars: DataFrame, by: list[str], order: str = "opens_at", width: int = 2, lookback: int = 120, most: int = 8) -> DataFrame:
    """Adds swing_highs and swing_lows: the last ``most`` confirmed ones, oldest first, and structure.

    A swing is above (below) ``width`` bars on each side, known ``width`` bars later, within the last ``lookback`` bars.
    """
    w = W.partitionBy(*by).orderBy(order)
    at = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    around = [k for k in range(2 * width + 1) if k != width]
    high, low = F.lit(True), F.lit(True)
    for k in around:
        high, low = high & (at("high", width) > at("high", k)), low & (at("low", width) < at("low", k))
    rows = bars.withColumn("_h", F.when(high, at("high", width))).withColumn("_l", F.when(low, at("low", width)))
    frame = w.rowsBetween(-(lookback - 2 * width - 1), 0)
    last = lambda c: F.reverse(F.slice(F.reverse(F.collect_list(c).over(frame)), 1, most))
    rows = rows.withColumn("swing_highs", last("_h")).withColumn("swing_lows", last("_l")).drop("_h", "_l")
    end = lambda c, k: F.try_element_at(c, F.lit(-k))
    up, rises = end("swing_highs", 1) > end("swing_highs", 2), end("swing_lows", 1) > end("swing_lows", 2)
    known = (F.size("swing_highs") >= 2) & (F.size("swing_lows") >= 2)
    name = F.when(~known, F.lit("UNCONFIRMED")).when(up & rises, F.lit("HIGHER_HIGHS_HIGHER_LOWS")).when(~up & ~rises, F.lit("LOWER_HIGHS_LOWER_LOWS")).otherwise(F.lit("RANGE_OR_TRANSITION"))
    return rows.withColumn("structure", name)


def patterns(rows: DataFrame, by: list[str], order: str = "opens_at") -> DataFrame:
    """Adds patterns, the names of seven candle patterns; hammer and star count near the last swing only."""
    w = W.partitionBy(*by).orderBy(order)
    o, h, low, c, a = (F.col(x) for x in ("open", "high", "low", "close", "atr_14"))
    po, ph, pl, pc = (F.lag(x).over(w) for x in ("open", "high", "low", "close"))
    body, span = F.abs(c - o), F.greatest(h - low, F.lit(0.01))
    upper, lower, long = h - F.greatest(o, c), F.least(o, c) - low, F.greatest(body * 2, span * 0.45)
    near = lambda x, pivots: F.coalesce(F.abs(x - F.try_element_at(pivots, F.lit(-1))) <= NEAR_PIVOT * a, F.lit(False))
    found = codes(
        ((c > o) & (pc < po) & (o <= pc) & (c >= po), "BULLISH_ENGULFING"), ((c < o) & (pc > po) & (o >= pc) & (c <= po), "BEARISH_ENGULFING"), (pc.isNotNull() & (body / span <= 0.15), "DOJI_INDECISION"),
        (pc.isNotNull() & (lower >= long) & (upper <= span * 0.2) & near(low, "swing_lows"), "HAMMER_REJECTION"), (pc.isNotNull() & (upper >= long) & (lower <= span * 0.2) & near(h, "swing_highs"), "SHOOTING_STAR_REJECTION"),
        ((h < ph) & (low > pl), "INSIDE_BAR_COMPRESSION"), ((h > ph) & (low < pl), "OUTSIDE_BAR_EXPANSION"),
    )
    return rows.withColumn("patterns", found)


def input_blockers(live: str, bars_5m: str, bars_15m: str, bars_1h: str, developing: str) -> Column:
    """Codes of what keeps an analysis from triggering: the feed's state, too few bars of a frame, a bar that is not final."""
    few = lambda n, name, least: (F.col(n) < least, F.concat(F.lit(f"INSUFFICIENT_{name}_HISTORY:"), F.col(n).cast("string"), F.lit(f"/{least}")))
    pairs = [
        (F.col(live) != "LIVE", F.concat(F.lit("DATA_NOT_LIVE_"), F.col(live))), few(bars_5m, "5M", PRIMARY_BARS), few(bars_15m, "15M", CONTEXT_BARS), few(bars_1h, "1H", CONTEXT_BARS),
        (F.col(developing), F.lit("DEVELOPING_CANDLE_IN_ANALYSIS_INPUT")),
    ]
    return F.array_compact(F.array(*[F.when(condition, code) for condition, code in pairs]))


def evidence(rows: DataFrame) -> DataFrame:
    """Adds evidence (array of label, score, trigger), score within +-100, bias and grade.

    Needs atr_14, trend_5m, trend_15m, trend_1h, ``swings``, ``patterns``, and the opening range and previous session of ``features.daily_state``.
    A previous session counts where previous_whole (if there is such a column) is true.
    """
    o, h, low, c, a = (F.col(x) for x in ("open", "high", "low", "close", "atr_14"))
    top, bottom = F.try_element_at("swing_highs", F.lit(-1)), F.try_element_at("swing_lows", F.lit(-1))
    buffer, body, span = BUFFER * a, c - o, F.greatest(h - low, F.lit(0.01))
    ready, whole = F.col("opening_ready"), F.coalesce("previous_whole", F.lit(False)) if "previous_whole" in rows.columns else F.lit(True)
    side = lambda name, up, down: F.when(F.col(name) == up, 1).when(F.col(name) == down, -1)
    item = lambda when, label, score, fires: F.when(when, F.struct(F.lit(label).alias("label"), score.cast("int").alias("score"), F.lit(fires).alias("trigger")))
    k = {n: F.lit(v) for n, v in WEIGHTS.items()}
    trends = [item(side(x, "BULLISH", "BEARISH").isNotNull(), x.upper(), side(x, "BULLISH", "BEARISH") * k[x], False) for x in ("trend_5m", "trend_15m", "trend_1h")]
    shape = side("structure", "HIGHER_HIGHS_HIGHER_LOWS", "LOWER_HIGHS_LOWER_LOWS")
    wide = (F.abs(body) / span >= 0.65) & (span >= 1.1 * a)
    found = [
        *trends, item(shape.isNotNull(), "STRUCTURE", shape * k["structure"], False),
        item(c > top + buffer, "BREAK_UP", k["break"], True), item(c < bottom - buffer, "BREAK_DOWN", -k["break"], True),
        item((low < bottom) & (c > bottom), "SWEEP_LOW", k["sweep"], True), item((h > top) & (c < top), "SWEEP_HIGH", -k["sweep"], True),
        item(ready & (c > F.col("opening_high") + buffer), "ABOVE_OPENING_RANGE", k["opening_range"], True), item(ready & (c < F.col("opening_low") - buffer), "BELOW_OPENING_RANGE", -k["opening_range"], True),
        item(whole & (c > F.col("previous_high") + buffer), "ABOVE_PREVIOUS_SESSION", k["previous_session"], True), item(whole & (c < F.col("previous_low") - buffer), "BELOW_PREVIOUS_SESSION", -k["previous_session"], True),
        item(wide, "RANGE_EXPANSION", F.when(body > 0, k["expansion"]).otherwise(-k["expansion"]), True),
        *[item(F.array_contains("patterns", n), n, F.lit(v), True) for n, v in PATTERN_WEIGHTS.items()],
    ]
    rows = pinned(rows, evidence=F.when(a > 0, F.array_compact(F.array(*found))))
    total = F.aggregate("evidence", F.lit(0), lambda s, x: s + x["score"])
    rows = pinned(rows, score=F.when(F.col("evidence").isNull(), F.lit(0)).otherwise(F.greatest(F.least(total, F.lit(100)), F.lit(-100))))
    grade = F.lit("NO_EDGE")
    for limit, name in reversed(GRADES):
        grade = F.when(F.abs("score") >= limit, F.lit(name)).otherwise(grade)
    bias = F.when(F.col("score") >= BIAS, F.lit("BULLISH")).when(F.col("score") <= -BIAS, F.lit("BEARISH")).otherwise(F.lit("NEUTRAL"))
    none = F.col("evidence").isNull()
    return rows.withColumn("bias", F.when(none, F.lit("UNAVAILABLE")).otherwise(bias)).withColumn("grade", F.when(none, F.lit("UNAVAILABLE")).otherwise(grade))


def levels(rows: DataFrame, most: int = 3) -> DataFrame:
    """Adds supports and resistances (arrays of price, kind, strength, touches), the nearest ``most`` on each side of the close.

    Swings (weight 2), the opening range and the previous session's extremes (3) and close (2) join, from below, the cluster whose mean
    price is within ``CLUSTER`` ranges. A level's price is the weighted mean, its kind the heaviest member's, its strength at most 5.
    """
    ready, whole = F.col("opening_ready"), F.coalesce("previous_whole", F.lit(False)) if "previous_whole" in rows.columns else F.lit(True)
    one = lambda when, price, kind, weight, k: F.array(F.when(when & price.isNotNull(), F.struct(price.cast("double").alias("price"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))))
    many = lambda c, kind, k: F.transform(c, lambda x: F.struct(x.cast("double").alias("price"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(2).alias("weight")))
    found = F.concat(
        many("swing_lows", "SWING_LOW", 0), many("swing_highs", "SWING_HIGH", 1), one(ready, F.col("opening_high"), "OPENING_RANGE_HIGH", 3, 2), one(ready, F.col("opening_low"), "OPENING_RANGE_LOW", 3, 3),
        one(whole, F.col("previous_high"), "PREVIOUS_DAY_HIGH", 3, 4), one(whole, F.col("previous_low"), "PREVIOUS_DAY_LOW", 3, 5), one(whole, F.col("previous_close"), "PREVIOUS_DAY_CLOSE", 2, 6),
    )
    rows = rows.withColumn("_p", F.array_sort(F.array_compact(found))).withColumn("_d", F.greatest(CLUSTER * F.col("atr_14"), F.lit(0.01)))
    # a cluster: sum and count of prices, weighted sum and weight, the heaviest kind and its weight; sorted prices can join the last one only
    joined = F.expr("""aggregate(_p, cast(array() as array<struct<s:double,n:int,ws:double,w:int,kind:string,top:int>>), (acc, x) -> case
        when size(acc) > 0 and abs(element_at(acc, -1).s / element_at(acc, -1).n - x.price) <= _d then concat(slice(acc, 1, size(acc) - 1), array(named_struct(
            's', element_at(acc, -1).s + x.price, 'n', element_at(acc, -1).n + 1, 'ws', element_at(acc, -1).ws + x.price * x.weight, 'w', element_at(acc, -1).w + x.weight,
            'kind', if(x.weight > element_at(acc, -1).top, x.kind, element_at(acc, -1).kind), 'top', greatest(x.weight, element_at(acc, -1).top))))
        else concat(acc, array(named_struct('s', x.price, 'n', 1, 'ws', x.price * x.weight, 'w', x.weight, 'kind', x.kind, 'top', x.weight))) end)""")
    level = lambda x: F.struct((x["ws"] / x["w"]).alias("price"), x["kind"].alias("kind"), F.least(x["w"], F.lit(5)).alias("strength"), x["n"].alias("touches"))
    rows = pinned(rows, _l=F.when(F.col("atr_14") > 0, F.array_sort(F.transform(joined, level))).otherwise(F.expr("cast(array() as array<struct<price:double,kind:string,strength:int,touches:int>>)")))
    below, above = F.filter("_l", lambda x: x["price"] <= F.col("close")), F.filter("_l", lambda x: x["price"] > F.col("close"))
    return rows.withColumn("supports", F.slice(F.reverse(below), 1, most)).withColumn("resistances", F.slice(above, 1, most)).drop("_p", "_d", "_l")


def setup(rows: DataFrame) -> DataFrame:
    """Adds setup from score, evidence and input_blockers (an array; any blocker leaves watching only)."""
    s, free = F.col("score"), F.size("input_blockers") == 0
    fires = lambda sign: F.exists("evidence", lambda x: x["trigger"] & (x["score"] * sign > 0))
    state = (
        F.when(free & (s >= TRIGGER) & fires(1), F.lit("BUY_TRIGGER")).when(free & (s <= -TRIGGER) & fires(-1), F.lit("SELL_TRIGGER"))
        .when(s >= WATCH, F.lit("BULLISH_WATCH")).when(s <= -WATCH, F.lit("BEARISH_WATCH")).otherwise(F.lit("WAIT"))
    )
    return pinned(rows, setup=F.when(F.col("evidence").isNull(), F.lit("UNAVAILABLE")).otherwise(state))


def plan(rows: DataFrame) -> DataFrame:
    """Adds trigger, entry_low, entry_high, stop, risk, three targets, expiry_bars, plan_blockers, and blockers; a blocked trigger goes back to watching.

    The trigger is the close once the setup has fired, else beyond the last swing (the bar's own extreme without one) by the buffer. The stop
    lies a buffer behind the nearest level, at least ``LEAST_RISK`` ranges away; without a level one range away.
    """
    a, c = F.col("atr_14"), F.col("close")
    rows = pinned(rows, _side=F.when(F.col("bias") == "BULLISH", 1).when(F.col("bias") == "BEARISH", -1))
    side, fired = F.col("_side"), F.col("setup").isin("BUY_TRIGGER", "SELL_TRIGGER")
    beyond = F.when(side > 0, F.greatest(c, F.coalesce(F.try_element_at("swing_highs", F.lit(-1)), "high") + BUFFER * a))
    beyond = beyond.otherwise(F.least(c, F.coalesce(F.try_element_at("swing_lows", F.lit(-1)), "low") - BUFFER * a))
    rows = pinned(rows, trigger=F.when(side.isNotNull(), F.when(fired, c).otherwise(beyond)))
    own, other = (F.when(side > 0, F.try_element_at(x, F.lit(1))["price"]).otherwise(F.try_element_at(y, F.lit(1))["price"]) for x, y in (("supports", "resistances"), ("resistances", "supports")))
    t = F.col("trigger")
    rows = pinned(rows, risk=F.when(side.isNotNull(), F.when(own.isNull(), a).otherwise(F.greatest(LEAST_RISK * a, side * (t - own) + BUFFER * a))))
    room = side * (other - t)
    blocked = codes((F.col("risk") > MOST_RISK * a, "STRUCTURE_STOP_EXCEEDS_1.5_ATR"), ((room > 0) & (room < F.col("risk")), "NEAREST_OPPOSING_LEVEL_INSIDE_1R"))
    rows = rows.withColumns({
        "entry_low": t - BUFFER * a, "entry_high": t + BUFFER * a, "stop": t - side * F.col("risk"), "expiry_bars": F.when(side.isNotNull(), F.lit(EXPIRY_BARS)), "plan_blockers": blocked,
        **{f"target_{k}": t + side * F.col("risk") * r for k, r in enumerate(TARGETS, 1)},
    })
    bad = F.size("plan_blockers") > 0
    watched = F.when(bad & (F.col("setup") == "BUY_TRIGGER"), F.lit("BULLISH_WATCH")).when(bad & (F.col("setup") == "SELL_TRIGGER"), F.lit("BEARISH_WATCH")).otherwise(F.col("setup"))
    blockers = F.array_sort(F.array_distinct(F.concat("input_blockers", F.transform("plan_blockers", lambda x: F.concat(F.lit("RISK_PLAN:"), x)))))
    return rows.withColumn("setup", watched).withColumn("blockers", blockers).drop("_side")


def volatility_regime(rows: DataFrame, by: list[str], order: str = "opens_at", n: int = 20) -> DataFrame:
    """Adds regime: the range over the upper median of its last ``n`` values (from the fifteenth bar on), UNAVAILABLE below 35 bars."""
    w = W.partitionBy(*by).orderBy(order)
    bar = F.row_number().over(w)
    past = F.array_sort(F.collect_list(F.when(F.col("_n") > 14, F.col("atr_14"))).over(w.rowsBetween(-(n - 1), 0)))
    rows = rows.withColumn("_n", bar).withColumn("_a", past).withColumn("_m", F.try_element_at("_a", F.floor(F.size("_a") / 2).cast("int") + 1))
    ratio = F.when(F.col("_m") > 0, F.col("atr_14") / F.col("_m")).otherwise(F.lit(1.0))
    name = F.when(ratio >= 1.25, F.lit("EXPANDING")).when(ratio <= 0.80, F.lit("COMPRESSED")).otherwise(F.lit("NORMAL"))
    return rows.withColumn("regime", F.when((F.col("_n") < 35) | F.col("_m").isNull(), F.lit("UNAVAILABLE")).otherwise(name)).drop("_n", "_a", "_m")


def analyse(rows: DataFrame, by: list[str], order: str = "opens_at") -> DataFrame:
    """All of the above for bars with atr_14, the trends of three frames, daily state, and input_blockers."""
    rows = levels(evidence(patterns(swings(rows, by, order), by, order)))
    return volatility_regime(plan(setup(rows)), by, order)
