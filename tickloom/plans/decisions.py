"""Queries over decisions: joins of series, labels, trades, folds, metrics, calibration, drift, and audit."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import canonical_hash, clip, uuid5
from ..operators import asof, audit, calibration, candles, features, folds, ingest, labels, metrics
from ..operators import recurrence as R
from ..sources.scratch import staged
from .registry import BARS, ORDERED, floored, hourly, query, rounded, table

BY, AT = ["event_type"], "opens_at"


def series():
    return W.partitionBy("event_type").orderBy("opens_at")
BARS4 = BARS + """, b4 AS (SELECT event_type, time_bucket(INTERVAL 4 hours, opens_at)::TIMESTAMP + INTERVAL 4 hours AS closes_at, arg_max(close, opens_at) AS close_4h, max(high) AS high_4h FROM bars GROUP BY 1, 2)"""


@query(f"""WITH {BARS4}, b1 AS (SELECT event_type, opens_at, opens_at + INTERVAL 1 hour AS decision_time, close FROM bars)
    SELECT b1.event_type, b1.opens_at, b1.close, b4.close_4h AS context_4h__close_4h, b4.high_4h AS context_4h__high_4h FROM b1 ASOF LEFT JOIN b4 ON b1.event_type = b4.event_type AND b1.decision_time >= b4.closes_at""")
def asof_4h_on_1h(spark, d):
    bars = hourly(spark, d)
    left = bars.select(*BY, AT, (F.col(AT) + F.expr("interval 1 hour")).alias("decision_time"), "close")
    coarse = bars.groupBy(*BY, (floored(AT, 14400) + F.expr("interval 4 hours")).alias("closes_at")).agg(F.max_by("close", AT).alias("close_4h"), F.max("high").alias("high_4h"))
    return asof.asof_join(left, coarse, BY, "decision_time", "closes_at", ["close_4h", "high_4h"], "context_4h__").drop("decision_time")


@query("""WITH e AS (SELECT * FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
    SELECT e.event_id, p.value AS last_purchase FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_by_user(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    p = rows.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_purchase"))
    return asof.asof_join(rows.where("event_type = 'error'"), p, ["user_id"], "ts", "at", ["last_purchase"]).select("event_id", "last_purchase")


@query("""SELECT e.event_id, count(v.event_id) AS n_views, round(sum(v.value), 6) AS sum_views FROM events e LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = e.user_id AND v.ts > e.ts AND v.ts <= e.ts + INTERVAL 6 hours
    WHERE e.event_type = 'error' GROUP BY 1 HAVING count(v.event_id) > 0""")
def forward_interval_join(spark, d):
    """What a user views in the six hours after an error."""
    rows = table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    e, v = rows.where("event_type = 'error'").select("event_id", "user_id", "s"), rows.where("event_type = 'view'").select("user_id", F.col("s").alias("view_s"), "value")
    out = asof.interval_join(e, v, ["user_id"], F.col("s") + 1e-6, F.col("s") + 21600.000001, "view_s", 21600)
    return out.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_views"), F.round(F.sum("value"), 6).alias("sum_views"))


@query("""SELECT o.o_orderkey, c.c_mktsegment, n.n_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'F'""")
def three_way_join(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_mktsegment", "n_name", "o_totalprice")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-30' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def pending_anti_join(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return audit.pending(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), done, "o_orderkey", "o_orderdate", F.expr("timestamp_ntz'1995-06-30'"))


@query("""WITH a AS (SELECT ts::DATE AS day, user_id, sum(value) AS x FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), b AS (SELECT ts::DATE AS day, user_id, sum(value) AS y FROM events WHERE event_type = 'error' GROUP BY 1, 2)
    SELECT coalesce(a.day, b.day) AS day, coalesce(a.user_id, b.user_id) AS user_id, round(coalesce(x, 0) - coalesce(y, 0), 6) AS uplift FROM a FULL JOIN b ON a.day = b.day AND a.user_id = b.user_id""")
def full_outer_uplift(spark, d):
    """A user's days of two kinds of events side by side, 0 where one has none."""
    rows = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    a = rows.where("event_type = 'purchase'").groupBy("day", "user_id").agg(F.sum("value").alias("x"))
    b = rows.where("event_type = 'error'").groupBy("day", "user_id").agg(F.sum("value").alias("y"))
    return a.join(b, ["day", "user_id"], "full_outer").select("day", "user_id", F.round(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)), 6).alias("uplift"))


@query("""SELECT event_type, user_id, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_at")).where("n > 1")


@query("""SELECT event_type, min(event_id) AS event_id, user_id, ts::DATE AS day FROM events GROUP BY event_type, user_id, ts::DATE""")
def dedupe_events(spark, d):
    """The first event of each identity (type, user, day)."""
    rows = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return candles.latest(rows, ["event_type", "user_id", "day"], [F.asc("event_id")]).select("event_type", "event_id", "user_id", "day")


@query("""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 4 = 0 THEN 'QUOTE' WHEN event_id % 29 = 0 THEN 'CORRECTION' ELSE 'TRADE' END AS kind, user_id % 6 AS ins, ts + to_seconds((event_id % 6)::INT - 1) - CASE WHEN event_id % 31 = 0 THEN INTERVAL 5 seconds ELSE INTERVAL 0 seconds END AS arrived,
      CASE WHEN event_id % 3 <> 0 THEN event_id % 40 - 1 END AS seq, CASE WHEN event_id % 3 <> 0 AND event_id % 43 <> 0 THEN 'day' END AS scope, value - 2 AS price FROM events),
    v AS (SELECT *, list_filter([CASE WHEN ins = 5 THEN 'UNKNOWN_INSTRUMENT' END, CASE WHEN seq < 0 THEN 'NEGATIVE_SEQUENCE' END, CASE WHEN seq IS NOT NULL AND scope IS NULL THEN 'SEQUENCE_SCOPE_REQUIRED' END, CASE WHEN ts > arrived + INTERVAL 2 seconds THEN 'EVENT_FROM_FUTURE' END,
      CASE WHEN arrived > ts + INTERVAL 3 seconds THEN 'LATE_ARRIVAL' END, CASE WHEN price <= 0 THEN 'PRICE_NOT_POSITIVE' END, CASE WHEN kind = 'CORRECTION' THEN 'CORRECTION_TARGET_REQUIRED' END], lambda x: x IS NOT NULL) AS issues FROM e),
    b AS (SELECT *, len(list_filter(issues, lambda x: x <> 'LATE_ARRIVAL')) > 0 AS bad FROM v),
    r AS (SELECT *, row_number() OVER (PARTITION BY bad, CASE WHEN ins < 5 THEN ins END, kind, seq, CASE WHEN seq IS NOT NULL THEN coalesce(scope, '') END, CASE WHEN seq IS NULL THEN ts END, CASE WHEN seq IS NULL THEN price END ORDER BY arrived, event_id) AS n FROM b)
    SELECT event_id, CASE WHEN bad THEN 'QUARANTINED' WHEN n > 1 THEN 'DUPLICATE' ELSE 'STORED' END AS status, array_to_string(issues, '|') AS issues FROM r""")
def validate_route(spark, d):
    """Normalisation, identity, codes, quarantine, and duplicates behind the first valid event of a sequence or content."""
    k = F.col("event_id")
    quote, corrects, sequenced = k % 4 == 0, k % 29 == 0, k % 3 != 0
    late = (F.unix_micros(F.col("ts").cast("timestamp")) + (k % 6 - 1) * 1000000 - F.when(k % 31 == 0, 5000000).otherwise(0))
    money = lambda c: c.cast("decimal(18,6)")
    given = {
        "provider": F.lit(" Feed "), "provider_instrument_id": (F.col("user_id") % 6).cast("string"), "event_type": F.when(quote, F.lit("QUOTE")).when(corrects, F.lit("CORRECTION")).otherwise(F.lit("TRADE")),
        "provider_event_time": F.col("ts").cast("timestamp"), "server_arrival_time": F.timestamp_micros(late), "provider_sequence": F.when(sequenced, k % 40 - 1), "provider_sequence_scope": F.when(sequenced & (k % 43 != 0), F.lit("day")),
        "price": money(F.col("value") - 2),
    }
    fields = [f.split()[:2] for f in ingest.RAW.replace("\n", " ").replace("decimal(18,6)", "decimal(18#6)").replace("map<string,string>", "map<string#string>").split(",")]
    rows = table(spark, d, "events").select(k.alias("source_id"), *[given.get(n, F.lit(None).cast(t.replace("#", ","))).alias(n) for n, t in fields])
    known = spark.createDataFrame([("feed", str(i), f"i{i}", True) for i in range(5)], "provider string, provider_instrument_id string, instrument_id string, supports_volume boolean")
    rows = rows.withColumn("_source", F.col("source_id"))
    out = ingest.route(ingest.identity(ingest.normalize(rows, known)), ["server_arrival_time", "_source"])
    return out.select(F.col("source_id").alias("event_id"), "status", F.concat_ws("|", "issues").alias("issues"))


@query("""WITH e AS (SELECT *, CAST(props->>'k' AS BIGINT) AS seq FROM events), m AS (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
    SELECT event_id, CASE WHEN last IS NULL THEN 'OK' WHEN seq < last THEN 'OUT_OF_ORDER' WHEN seq > last + 1 THEN 'GAP' ELSE 'OK' END AS mark FROM m""")
def sequence_marks(spark, d):
    rows = table(spark, d, "events").withColumn("seq", F.get_json_object("props", "$.k").cast("long"))
    return ingest.sequence_marks(rows, ["user_id"], "seq", ["ts", "event_id"]).select("event_id", "mark")


@query("""SELECT event_id, sha256('{"' || 'type' || '":"' || event_type || '","' || 'user' || '":"' || user_id || '"}') AS payload_hash FROM events""")
def payload_hash(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", canonical_hash(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))).alias("payload_hash"))


@query(f"""WITH h AS (SELECT event_id, sha1(unhex('{ingest.NAMESPACE.replace("-", "")}') || encode(event_type || '|' || user_id || '|' || event_id)) AS d FROM events)
    SELECT event_id, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || CASE d[17] WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || d[18:20] || '-' || d[21:32] AS uuid FROM h""")
def event_uuid(spark, d):
    """Version 5 UUIDs of event identities."""
    rows = table(spark, d, "events")
    return rows.select("event_id", uuid5(ingest.NAMESPACE, F.concat_ws("|", "event_type", "user_id", "event_id")).alias("uuid"))


def _with_atr(spark, d):
    return R.atr(hourly(spark, d), 14, BY, AT, "atr").withColumn("atr", F.round("atr", 6))


_ATR = """WITH RECURSIVE {ordered}, t AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM s),
    rec AS (SELECT x.event_type, x.n, x.tr AS total, CAST(NULL AS DOUBLE) AS y FROM t x WHERE x.n = 1 UNION ALL
      SELECT x.event_type, x.n, p.total + x.tr, CASE WHEN x.n = 14 THEN (p.total + x.tr) / 14 WHEN x.n > 14 THEN (p.y * 13 + x.tr) / 14 END FROM rec p JOIN t x ON x.event_type = p.event_type AND x.n = p.n + 1),
    a AS (SELECT t.*, round(rec.y, 6) AS atr FROM t JOIN rec USING (event_type, n))""".format(ordered=ORDERED)


@query(_ATR + """, f AS (SELECT a.event_type, a.n, a.opens_at, a.close, a.atr, count(b.n) AS k, min(CASE WHEN b.high >= a.close + a.atr THEN b.n - a.n END) AS up, min(CASE WHEN b.low <= a.close - a.atr THEN b.n - a.n END) AS down
      FROM a LEFT JOIN a b ON b.event_type = a.event_type AND b.n BETWEEN a.n + 1 AND a.n + 12 GROUP BY ALL),
    r AS (SELECT *, CASE WHEN atr IS NULL THEN 'ATR_AT_DECISION_UNAVAILABLE' WHEN k < 12 THEN 'INCOMPLETE_FUTURE_WINDOW' WHEN up = down THEN 'AMBIGUOUS_TOUCH' END AS reason FROM f)
    SELECT event_type, opens_at, reason, CASE WHEN reason = 'AMBIGUOUS_TOUCH' THEN 'AMBIGUOUS' WHEN reason IS NOT NULL THEN NULL WHEN up IS NULL AND down IS NULL THEN 'NEITHER' WHEN down IS NULL OR up < down THEN 'UP' ELSE 'DOWN' END AS outcome,
    (CASE WHEN reason IS NULL THEN least(coalesce(up, 99), coalesce(down, 99)) END % 99)::INT AS bars_to_touch FROM r""")
def first_touch(spark, d):
    out = labels.first_touch(_with_atr(spark, d), BY, AT, "atr")
    # the oracle writes 0 for labels without a touch
    k = F.when(F.col("reason").isNull(), F.coalesce("bars_to_touch", F.lit(0)))
    return out.select(*BY, AT, "reason", "outcome", k.alias("bars_to_touch"))


def _path_sql(side: int) -> str:
    hit_t, hit_s = ("b.high >= e.t", "b.low <= e.st") if side > 0 else ("b.low <= e.t", "b.high >= e.st")
    return _ATR + f""", e AS (SELECT a.event_type, a.n, a.opens_at, a.atr, x.open AS entry, x.open + {side} * a.atr AS t, x.open - {side} * 0.75 * a.atr AS st FROM a JOIN a x ON x.event_type = a.event_type AND x.n = a.n + 1 WHERE a.atr > 0),
      f AS (SELECT e.event_type, e.n, e.opens_at, e.atr, e.entry, e.t, e.st, count(*) AS k, min(CASE WHEN {hit_t} THEN b.n - e.n END) AS ti, min(CASE WHEN {hit_s} THEN b.n - e.n END) AS si, max(CASE WHEN b.n = e.n + 12 THEN b.close END) AS last
        FROM e JOIN a b ON b.event_type = e.event_type AND b.n BETWEEN e.n + 1 AND e.n + 12 GROUP BY ALL HAVING count(*) = 12),
      g AS (SELECT *, CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN 'STOP' WHEN ti IS NOT NULL THEN 'TARGET' ELSE 'HORIZON' END AS exit_reason FROM f)
      SELECT event_type, opens_at, exit_reason, (CASE exit_reason WHEN 'STOP' THEN si WHEN 'TARGET' THEN ti ELSE 12 END)::INT AS exit_bar,
      round({side} * (CASE exit_reason WHEN 'STOP' THEN st WHEN 'TARGET' THEN t ELSE last END - entry) - 1, 9) AS net_points FROM g"""


def _path(spark, d, side):
    out = labels.trade_path(_with_atr(spark, d), BY, AT, "atr", side, slippage=0.5)
    return rounded(out, ["net_points"], 9).select(*BY, AT, "exit_reason", "exit_bar", "net_points")


@query(_path_sql(1))
def trade_path_long(spark, d):
    return _path(spark, d, 1)


@query(_path_sql(-1))
def trade_path_short(spark, d):
    return _path(spark, d, -1)


@query("""WITH RECURSIVE i AS (SELECT event_id, event_type, epoch_us(ts) AS a, epoch_us(ts) + (1 + event_id % 9) * 3600000000 AS b FROM events WHERE event_type IN ('error', 'signup')),
    o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY a, b) AS n FROM i),
    r AS (SELECT event_type, n, event_id, b AS until, true AS taken FROM o WHERE n = 1 UNION ALL
      SELECT o.event_type, o.n, o.event_id, CASE WHEN o.a >= r.until THEN o.b ELSE r.until END, o.a >= r.until FROM r JOIN o ON o.event_type = r.event_type AND o.n = r.n + 1) SELECT event_id, taken FROM r""")
def nonoverlap_trades(spark, d):
    rows = table(spark, d, "events").where("event_type in ('error', 'signup')")
    a = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = rows.select("event_id", "event_type", a.alias("a"), (a + (1 + F.col("event_id") % 9) * 3600000000).alias("b"))
    return labels.non_overlapping(rows, BY, "a", "b").select("event_id", "taken")


@query("""WITH RECURSIVE o AS (SELECT event_type, ts::DATE::VARCHAR AS day, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS b, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events),
    r AS (SELECT event_type, n, day, b AS until, 1 AS k, true AS taken FROM o WHERE n = 1 UNION ALL SELECT o.event_type, o.n, o.day, CASE WHEN o.a >= r.until AND (o.day <> r.day OR r.k < 2) THEN o.b ELSE r.until END,
      CASE WHEN o.day <> r.day THEN (o.a >= r.until)::INT ELSE r.k + (o.a >= r.until AND r.k < 2)::INT END, o.a >= r.until AND (o.day <> r.day OR r.k < 2) FROM r JOIN o ON o.event_type = r.event_type AND o.n = r.n + 1)
    SELECT event_type, day, count(*) FILTER (taken) AS n_taken, count(*) AS n FROM r GROUP BY 1, 2""")
def nonoverlap_daily_cap(spark, d):
    """At most two trades a day, none overlapping."""
    a = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("date").cast("string").alias("day"), a.alias("a"), (a + 3600000000).alias("b"))
    return labels.non_overlapping(rows, BY, "a", "b", "day", 2).groupBy("event_type", "day").agg(F.count_if("taken").alias("n_taken"), F.count(F.lit(1)).alias("n"))


_TRADES = "t AS (SELECT event_type, event_id, ts, value - 60 AS net_points, (value - 60) / 50 AS r FROM events)"


@query(f"""WITH {_TRADES}, c AS (SELECT *, sum(r) OVER w AS cum, sum((net_points > 0)::INT) OVER w AS run FROM t WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS peak, count(*) FILTER (net_points <= 0) OVER (PARTITION BY event_type, run) AS streak FROM c)
    SELECT event_type, count(*) AS n_trades, count(*) FILTER (net_points > 0) AS n_wins, round(avg((net_points > 0)::INT), 6) AS win_rate, round(sum(net_points), 4) AS net_points, round(avg(r), 6) AS mean_r,
    round(sum(net_points) FILTER (net_points > 0) / -sum(net_points) FILTER (net_points < 0), 6) AS profit_factor, round(max(peak - cum), 5) AS max_drawdown, max(streak) AS max_consecutive_losses,
    round(avg(r) - 1.96 * stddev_samp(r) / sqrt(count(*)), 6) AS mean_r_lower FROM p GROUP BY 1""")
def trade_metrics(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", (F.col("value") - 60).alias("net_points"), ((F.col("value") - 60) / 50).alias("r"))
    out = rounded(metrics.trade_metrics(rows, BY, "event_id", "net_points", "r"), ["win_rate", "mean_r", "profit_factor", "mean_r_lower"])
    return rounded(rounded(out, ["net_points"], 4), ["max_drawdown"], 5)


#: Probabilities of three classes and an outcome, made from an event's numbers.
_PRED = """e AS (SELECT event_id, event_type, 1 + event_id % 7 AS a, 1 + event_id % 5 AS b, 1 + event_id % 11 AS c, CASE event_id % 3 WHEN 0 THEN 'DOWN' WHEN 1 THEN 'NEITHER' ELSE 'UP' END AS actual FROM events),
    p AS (SELECT *, a / (a + b + c)::DOUBLE AS p_down, b / (a + b + c)::DOUBLE AS p_neither, c / (a + b + c)::DOUBLE AS p_up FROM e)"""
P = ["p_down", "p_neither", "p_up"]


def _predictions(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value", *[(1 + F.col("event_id") % k).alias(n) for k, n in ((7, "a"), (5, "b"), (11, "c"))], F.element_at(F.array(*map(F.lit, metrics.CLASSES)), (F.col("event_id") % 3 + 1).cast("int")).alias("actual"))
    total = F.col("a") + F.col("b") + F.col("c")
    return e.select("event_id", "event_type", "ts", "value", "actual", *[(F.col(x) / total).alias(n) for x, n in zip("abc", P)])


_BEST = "CASE WHEN p_down >= p_neither AND p_down >= p_up THEN 'DOWN' WHEN p_neither >= p_up THEN 'NEITHER' ELSE 'UP' END"


@query(f"""WITH {_PRED}, q AS (SELECT *, {_BEST} AS best FROM p) SELECT event_type, count(*) AS n, round(avg((best = actual)::INT), 6) AS accuracy,
    round((avg((best = actual)::INT) FILTER (actual = 'DOWN') + avg((best = actual)::INT) FILTER (actual = 'NEITHER') + avg((best = actual)::INT) FILTER (actual = 'UP')) / 3, 6) AS balanced_accuracy,
    round(avg((p_down - (actual = 'DOWN')::INT) ** 2 + (p_neither - (actual = 'NEITHER')::INT) ** 2 + (p_up - (actual = 'UP')::INT) ** 2), 6) AS brier,
    round(avg(-ln(CASE actual WHEN 'DOWN' THEN p_down WHEN 'NEITHER' THEN p_neither ELSE p_up END)), 6) AS log_loss, count(*) FILTER (actual = 'UP') AS support_up FROM q GROUP BY 1""")
def class_metrics(spark, d):
    out = metrics.class_metrics(_predictions(spark, d), BY, P)
    return rounded(out, ["accuracy", "balanced_accuracy", "brier", "log_loss"]).select(*BY, "n", "accuracy", "balanced_accuracy", "brier", "log_loss", "support_up")


_BINS = f"""{_PRED}, q AS (SELECT event_type, greatest(p_down, p_neither, p_up) AS conf, ({_BEST} = actual)::INT AS hit FROM p), b AS (SELECT event_type, least(floor(conf * 10), 9)::INT AS bin, count(*) AS n, avg(conf) AS mc, avg(hit) AS hr FROM q GROUP BY 1, 2)"""


def _bins(spark, d):
    p = _predictions(spark, d).select("event_type", F.greatest(*P).alias("conf"), (metrics.argmax(P) == F.col("actual")).alias("hit"))
    return metrics.calibration_bins(p, BY, "conf", "hit")


@query(f"WITH {_BINS} SELECT event_type, bin, n, round(mc, 6) AS mean_confidence, round(hr, 6) AS hit_rate FROM b")
def ece_bins(spark, d):
    return rounded(_bins(spark, d), ["mean_confidence", "hit_rate"])


@query(f"WITH {_BINS} SELECT event_type, round(sum(n * abs(mc - hr)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def calibration_error(spark, d):
    return rounded(metrics.calibration_error(_bins(spark, d), BY), ["ece"])


@query(f"""WITH {_PRED}, t AS (SELECT event_id, exp(ln(p_down) / 1.7) AS x, exp(ln(p_neither) / 1.7) AS y, exp(ln(p_up) / 1.7) AS z FROM p) SELECT event_id, round(x / (x + y + z), 6) AS t_down, round(y / (x + y + z), 6) AS t_neither, round(z / (x + y + z), 6) AS t_up FROM t""")
def temperature_apply(spark, d):
    x = calibration.tempered(P, 1.7)
    return rounded(_predictions(spark, d).select("event_id", *[c.alias(n) for c, n in zip(x, ("t_down", "t_neither", "t_up"))]), ["t_down", "t_neither", "t_up"])


@query()
def temperature_fit(spark, d):
    """The fitted temperature of each whole table, to three digits."""
    t = calibration.fit_temperature(_predictions(spark, d), P, "actual", metrics.CLASSES)
    return spark.range(1).select(F.lit(round(t, 3)).alias("temperature"))


_BINARY = "s AS (SELECT event_type, event_id, (1 + event_id % 97) / 100.0::DOUBLE AS score, (event_id % 3 = 0)::INT AS y, value FROM events)"


def _binary(spark, d):
    return table(spark, d, "events").select("event_type", "event_id", ((1 + F.col("event_id") % 97) / 100.0).alias("score"), (F.col("event_id") % 3 == 0).cast("int").alias("y"), "value")


@query(f"""WITH {_BINARY}, l AS (SELECT event_type, score, count(*)::DOUBLE AS k, sum(y)::DOUBLE AS h FROM s GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY event_type ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
      sum(h) OVER (PARTITION BY event_type ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / sum(k) OVER (PARTITION BY event_type ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS prec FROM l),
    z AS (SELECT event_type, (sum(h * (below + (k + 1) / 2)) - sum(h) * (sum(h) + 1) / 2) / (sum(h) * sum(k - h)) AS auc, sum(h * prec) / sum(h) AS ap FROM c GROUP BY 1)
    SELECT s.event_type, count(*) AS n, round(avg((score - y) ** 2), 6) AS brier, round(avg(-(y * ln(score) + (1 - y) * ln(1 - score))), 6) AS log_loss, round(any_value(auc), 6) AS auc, round(any_value(ap), 6) AS average_precision FROM s JOIN z USING (event_type) GROUP BY 1""")
def roc_auc(spark, d):
    out = metrics.binary_metrics(_binary(spark, d), BY, "score", "y")
    return rounded(out, ["brier", "log_loss", "auc", "average_precision"]).drop("score_sd")


@query(f"""WITH {_BINARY}, c AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY score) + (count(*) OVER (PARTITION BY event_type, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS b FROM s)
    SELECT event_type, count(*) AS n, round(corr(a::DOUBLE, b::DOUBLE), 6) AS spearman FROM c GROUP BY 1""")
def rank_correlation(spark, d):
    return rounded(metrics.rank_correlation(_binary(spark, d), BY, "score", "value"), ["spearman"])


@query(f"WITH {_BINARY} SELECT event_type, least(floor(score * 10), 9)::INT AS decile, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg((value > 0)::INT), 6) AS win_rate FROM s GROUP BY 1, 2")
def score_deciles(spark, d):
    return rounded(metrics.deciles(_binary(spark, d), BY, "score", "value"), ["mean_value", "win_rate"])


@query("""WITH a AS (SELECT event_id, value FROM events WHERE event_type = 'error'), r AS (SELECT value FROM events WHERE event_type = 'signup') SELECT event_id, round((SELECT count(*) FROM r WHERE r.value <= a.value) / (SELECT count(*) FROM r)::DOUBLE, 6) AS percentile FROM a""")
def percentile_reference(spark, d):
    e = table(spark, d, "events")
    out = folds.reference_percentile(e.where("event_type = 'error'").select("event_id", "value"), e.where("event_type = 'signup'").select("value"), "value", "percentile")
    return rounded(out, ["percentile"]).select("event_id", "percentile")


@query("""WITH a AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')
    SELECT a.event_id, round(CASE WHEN a.n > 1 THEN count(b.n) / (a.n - 1)::DOUBLE END, 6) AS percentile FROM a LEFT JOIN a b ON b.n < a.n AND b.value <= a.value GROUP BY a.event_id, a.n""")
def causal_percentile(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("event_type", "event_id", "ts", "value")
    return rounded(folds.causal_percentile(e, BY, ["ts", "event_id"], "value", "percentile"), ["percentile"]).select("event_id", "percentile")


@query("""WITH n AS (SELECT event_type, event_id, ts, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS k FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), f AS (SELECT *, floor((i - (k - 200)) / 50.0)::INT AS fold FROM n),
    s AS (SELECT event_type, fold, min(ts) AS start FROM f WHERE fold >= 0 GROUP BY 1, 2)
    SELECT s.fold AS fold_index, 'train' AS role, f.event_type, f.event_id FROM f JOIN s ON f.event_type = s.event_type AND f.ts + INTERVAL 1 hour <= s.start - INTERVAL 2 hours UNION ALL SELECT fold, 'test', event_type, event_id FROM f WHERE fold >= 0""")
def walk_forward_folds(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", "ts", (F.col("ts") + F.expr("interval 1 hour")).alias("label_end"))
    return folds.walk_forward(rows, BY, "ts", "label_end", 4, 50, 7200.0).select("fold_index", "role", "event_type", "event_id")


@query("""WITH e AS (SELECT event_id, ts::DATE AS day, count(*) OVER (PARTITION BY ts::DATE) AS k FROM events), t AS (SELECT count(*) AS n, count(DISTINCT day) AS s FROM e) SELECT event_id, round(n / s::DOUBLE / k, 6) AS weight FROM e, t""")
def session_weights(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return rounded(folds.session_weights(rows, "day"), ["weight"]).select("event_id", "weight")


@query("""WITH m AS (SELECT avg(value) AS m FROM events), e AS (SELECT *, hour(ts) AS h, user_id % 4 AS g FROM events), a AS (SELECT h, sum(value - m) / (count(*) + 50) AS x FROM e, m GROUP BY 1), b AS (SELECT g, event_type, sum(value - m) / (count(*) + 50) AS y FROM e, m GROUP BY 1, 2)
    SELECT event_id, round(least(greatest(m + x + y, -100), 100), 5) AS baseline FROM e, m, a, b WHERE e.h = a.h AND e.g = b.g AND e.event_type = b.event_type""")
def shrunken_regime_baseline(spark, d):
    rows = table(spark, d, "events").withColumn("h", F.hour("ts")).withColumn("g", F.col("user_id") % 4)
    out = folds.regime_baseline(rows, "value", {"time": ["h"], "regime": ["g", "event_type"]}, clip_at=100.0)
    return rounded(out, ["baseline"], 5).select("event_id", "baseline")


@query("""WITH a AS (SELECT least(floor(value / 20), 9)::INT AS bin, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT least(floor(value / 20), 9)::INT AS bin, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1),
    j AS (SELECT greatest(coalesce(a.n, 0) / (SELECT sum(n) FROM a)::DOUBLE, 1e-12) AS p, greatest(coalesce(b.n, 0) / (SELECT sum(n) FROM b)::DOUBLE, 1e-12) AS q FROM a FULL JOIN b ON a.bin = b.bin)
    SELECT round(sum((q - p) * ln(q / p)), 6) AS psi, round(sum(p * ln(2 * p / (p + q)) / 2 + q * ln(2 * q / (p + q)) / 2), 6) AS jsd FROM j""")
def psi_jsd(spark, d):
    rows = table(spark, d, "events").select("ts", F.least(F.floor(F.col("value") / 20), F.lit(9)).cast("int").alias("bin"))
    cut = F.expr("timestamp_ntz'2024-01-15'")
    a, b = (rows.where(c).groupBy("bin").agg(F.count(F.lit(1)).alias("n")) for c in (F.col("ts") < cut, F.col("ts") >= cut))
    return rounded(metrics.stability(a, b, ["bin"], "n"), ["psi", "jsd"])


@query("""WITH a AS (SELECT event_type, count(*)::DOUBLE AS n, count(*) FILTER (value > 100)::DOUBLE AS k FROM events GROUP BY 1), b AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM a)
    SELECT event_type, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS wilson_low, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS wilson_high FROM b""")
def wilson(spark, d):
    a = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("value") > 100).cast("double").alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return rounded(a.select("event_type", low.alias("wilson_low"), high.alias("wilson_high")), ["wilson_low", "wilson_high"])


#: The cumulative Poisson(1) probabilities that a uniform number is held against.
_EDGES = [math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1)) for n in range(18)]


@query(f"""WITH s AS (SELECT event_type, ts::DATE AS day, sum(value) AS total, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT s.*, draw, ('0x' || md5(concat_ws('|', '1701', draw, event_type, day))[1:13])::BIGINT / pow(2, 52) AS u FROM s, range(1, 1001) r(draw)),
    w AS (SELECT *, {" + ".join(f"(u >= {e!r})::INT" for e in _EDGES if e < 1 - 1e-12)} AS w FROM u), m AS (SELECT event_type, draw, CASE WHEN sum(w * n) <> 0 THEN sum(w * total) / sum(w * n) END AS mean, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT event_type, max(n) AS n_sessions, """ + ", ".join(f"round(CASE WHEN max(n) >= 2 THEN quantile_cont(mean, {q}) END, 6) AS q_{q[2:]}" for q in ("0.025", "0.5", "0.975")) + " FROM m GROUP BY 1")
def session_bootstrap(spark, d):
    """Intervals of mean values by days drawn anew."""
    s = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return rounded(metrics.session_bootstrap(s, BY, "day", "total", "n"), ["q_025", "q_5", "q_975"])


@query("""SELECT event_type, user_id, count(*) AS n_events, count(*) FILTER (value > 100) AS n_large, CASE WHEN count(*) >= 30 THEN round(avg(value), 6) END AS mean_value FROM events GROUP BY 1, 2""")
def gated_analytics(spark, d):
    """Means stay null until there are thirty rows."""
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(n.alias("n_events"), F.count_if(F.col("value") > 100).alias("n_large"), F.when(n >= 30, F.round(F.avg("value"), 6)).alias("mean_value"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 hour PRECEDING AND CURRENT ROW) AS n_recent, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 hour PRECEDING AND CURRENT ROW) > 2 AS limited FROM events""")
def rate_limit(spark, d):
    """Requests of a client in the sliding hour up to each."""
    rows = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    n = F.count(F.lit(1)).over(W.partitionBy("user_id").orderBy("us").rangeBetween(-3600000000, 0))
    return rows.select("event_id", n.alias("n_recent"), (n > 2).alias("limited"))


@query("""WITH RECURSIVE e AS (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events), h AS (SELECT event_type, n, event_id, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || '|' || event_id || '|' || user_id) AS event_hash FROM e WHERE n = 1
    UNION ALL SELECT e.event_type, e.n, e.event_id, h.event_hash, sha256(h.event_hash || '|' || e.event_id || '|' || e.user_id) FROM h JOIN e ON e.event_type = h.event_type AND e.n = h.n + 1) SELECT event_type, event_id, previous_hash, event_hash FROM h""")
def audit_chain(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", "user_id")
    return audit.chained(rows, BY, "event_id", ["event_id", "user_id"]).drop("user_id")


@query("SELECT count(*) FILTER (event_id % 97 = 0) AS n_broken, count(*) AS n FROM events")
def audit_verify(spark, d):
    """Finds the rows of a chain whose content has been changed."""
    rows = audit_chain(spark, d).join(table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 97 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id")), "event_id")
    rows = staged(rows, "chain")
    bad = audit.broken(rows, BY, "event_id", ["event_id", "user_id"])
    return rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(bad.agg(F.count(F.lit(1)).alias("n_broken")))  # one row each


@query(f"""WITH {ORDERED}, x AS (SELECT *, close > max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS up, close < min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS down, close > open AND lag(close) OVER w > lag(open) OVER w AS rise FROM s WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)),
    b AS (SELECT event_type, opens_at, coalesce(up, false) AND NOT coalesce(lag(up) OVER v, false) AS u, coalesce(down, false) AND NOT coalesce(lag(down) OVER v, false) AS d, coalesce(rise, false) AND NOT coalesce(lag(rise) OVER v, false) AS r FROM x WINDOW v AS (PARTITION BY event_type, session_date ORDER BY opens_at))
    SELECT event_type, opens_at, CASE WHEN (u OR r) AND d THEN NULL WHEN u THEN 'breakout_up' WHEN d THEN 'breakout_down' WHEN r THEN 'rising' END AS setup, (CASE WHEN (u OR r) AND d THEN NULL WHEN u OR r THEN 1 WHEN d THEN -1 END)::INT AS direction,
    CASE WHEN (u OR r) AND d THEN 'CONFLICTING_DIRECTIONS' WHEN NOT (u OR r OR d) THEN 'NO_EVENT' END AS wait_reason FROM b""")
def event_setups(spark, d):
    """Setups that begin at a bar, with conflicting directions waiting."""
    w = series()
    rows = hourly(spark, d).withColumn("high_20", F.max("high").over(w.rowsBetween(-20, -1))).withColumn("low_20", F.min("low").over(w.rowsBetween(-20, -1)))
    c = F.col("close")
    setups = {"breakout_up": (c > F.col("high_20"), 1), "breakout_down": (c < F.col("low_20"), -1), "rising": ((c > F.col("open")) & (F.lag("close").over(w) > F.lag("open").over(w)), 1)}
    return labels.events(rows, BY, "session_date", AT, setups).select(*BY, AT, "setup", "direction", "wait_reason")


#: One bar of a plan: (a) is the state before it, (x) the bar, both as one row; targets at 1.25, 2 and 3 risks take a third each.
_SCALE_OUT = _ATR + """, plans AS (SELECT event_type, n, opens_at, 1 AS side, close + 0.05 * atr AS trigger, 0.5 * atr AS zone, 0.65 * atr AS risk, lead(close, 12) OVER (PARTITION BY event_type ORDER BY n) AS last FROM a QUALIFY atr > 0 AND last IS NOT NULL),
    st AS (SELECT event_type, n, 0 AS bar, 'WAITING' AS state, NULL::DOUBLE AS entry, NULL::DOUBLE AS stop, 0 AS done, 0::DOUBLE AS r, NULL::INT AS exit_bar FROM plans
      UNION ALL SELECT event_type, n, bar + 1, CASE WHEN kept THEN state WHEN hit OR reach = 3 THEN 'CLOSED' ELSE 'OPEN' END, CASE WHEN kept THEN entry0 ELSE en END, CASE WHEN kept THEN stop0 WHEN NOT hit AND reach > 0 THEN en ELSE sp END, CASE WHEN kept OR hit THEN done ELSE reach END,
        CASE WHEN kept THEN r WHEN hit THEN r + (1 - done / 3) * (sp - en - 0.5) / risk ELSE r + (list_sum(list_concat([0::DOUBLE], [1.25, 2.0, 3.0][done + 1:reach])) / 3) END, CASE WHEN kept THEN CASE WHEN state = 'MISSED' AND exit_bar IS NULL THEN bar + 1 ELSE exit_bar END WHEN hit OR reach = 3 THEN bar + 1 ELSE exit_bar END
      FROM (SELECT z.*, greatest(done, CASE WHEN h >= en + risk * 3 THEN 3 WHEN h >= en + risk * 2 THEN 2 WHEN h >= en + risk * 1.25 THEN 1 ELSE 0 END) AS reach, l <= sp AS hit
        FROM (SELECT y.*, coalesce(stop0, en - risk) AS sp FROM (SELECT q.event_type, q.n, q.bar, q.done, q.r, q.exit_bar, q.entry AS entry0, q.stop AS stop0, p.risk, x.high AS h, x.low AS l, coalesce(q.entry, greatest(x.open, p.trigger) + 0.5) AS en,
            CASE WHEN q.state = 'WAITING' AND x.open - p.trigger > p.zone THEN 'MISSED' ELSE q.state END AS state, q.state IN ('MISSED', 'CLOSED') OR q.state = 'WAITING' AND (x.open - p.trigger > p.zone OR x.high < p.trigger) AS kept
          FROM st q JOIN plans p USING (event_type, n) JOIN a x ON x.event_type = q.event_type AND x.n = q.n + q.bar + 1 WHERE q.bar < 12) y) z))"""


@query(_SCALE_OUT + """ SELECT event_type, opens_at, side, trigger, zone, risk, round(r + CASE WHEN state = 'OPEN' THEN (1 - done / 3) * (last - entry - 0.5) / risk ELSE 0 END, 5) + 0 AS r_multiple,
    CASE state WHEN 'OPEN' THEN 'HORIZON' WHEN 'WAITING' THEN 'NOT_TRIGGERED' ELSE state END AS state, coalesce(exit_bar, 12) AS exit_bar FROM st JOIN plans USING (event_type, n) WHERE bar = 12""")
def scale_out_replay(spark, d):
    """A plan at every bar, left in thirds."""
    rows = asof.next_rows(_with_atr(spark, d), BY, AT, ["open", "high", "low", "close"], 12, "path").where("atr > 0 and size(path) = 12")
    path = F.transform("path", lambda x: F.struct(x["open"].alias("o"), x["high"].alias("h"), x["low"].alias("l"), x["close"].alias("c")))
    plans = rows.select(*BY, AT, F.lit(1).alias("side"), (F.col("close") + 0.05 * F.col("atr")).alias("trigger"), (0.5 * F.col("atr")).alias("zone"), (0.65 * F.col("atr")).alias("risk"), path.alias("path"))
    out = labels.replay_plan(plans, "thirds", 0.5).drop("path")
    return rounded(out, ["r_multiple"], 5)


@query("""SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS n, (SELECT count(*) FROM lineitem) AS n_lines, (SELECT max(o_orderdate) FROM orders) AS last_at""")
def status_counts(spark, d):
    o = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last_at"))
    return o.crossJoin(table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n_lines"))).select(F.lit("orders").alias("name"), "n", "n_lines", "last_at")  # one row each


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("count_order"),
    )


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY 1""")
def best_candidate(spark, d):
    return folds.best_candidate(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", ["o_totalprice"]).withColumnRenamed("o_orderkey", "best")
