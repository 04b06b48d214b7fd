"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, group, least length of the group.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # maximal runs, so the same spans as [0-9a-f]+ of 32 or more
)
KINDS = [k for k, *_ in PATTERNS] + ["random"]
#: Runs of letters that an encoded secret may use.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
HEX, BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: What written text does in the alphabets of hex, base32 and base64. Sum of squared letter frequencies, for what a chi-squared test
#: expects of words; changes between capitals, small letters and digits a letter; share of a text's letters that fit hex, of digits that fit base32.
TEXT_CONCENTRATION, TEXT_CHANGES = (0.12, 0.065, 0.065), (0.12, 0.08, 0.35)
HEX_LETTERS, BASE32_DIGITS = 0.35, 0.6
#: Upper ends of the length classes within which false discoveries are held; the last is open.
LENGTH_CLASSES = (24, 32, 48, 64, 96, 128, 256)


def _spans(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """Structs (start, kind's number, end, found) of the leftmost matches that do not overlap, failing ones dropped."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    step = lambda acc, i: F.struct(
        (acc["at"] + F.length(gaps[i]) + F.length(whole[i])).alias("at"),
        F.when(F.length(part[i]) >= least, F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(gaps[i])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (acc["at"] + F.length(gaps[i]) + F.length(whole[i])).alias("end"), whole[i].alias("found"))))).otherwise(acc["spans"]).alias("spans"),
    )
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,found:string>>)")
    n = F.size(whole)
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])
    return F.when(text.rlike(pattern), folded).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) by a polynomial (absolute error below 1e-7) with an exponential factor."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _tests(found: Column) -> Column:
    """Structs (start, end, length_class, random, worded) of candidate spans; each step adds what the next one needs."""
    log_tail = lambda p: -F.log(F.greatest(p, F.lit(1e-12)))
    size = lambda s, pattern: F.length(F.regexp_replace(s, pattern, "")).cast("double")

    def encoded(s: Column) -> Column:
        core = F.regexp_replace(F.translate(s["found"], "-_", "+/"), "=+$", "")
        lower = F.lower(core)
        hexes, b32 = lower.rlike("^[0-9a-f]+$") & ((core == lower) | (core == F.upper(core))), core.rlike("^[A-Z2-7]+$")
        kind = F.when(hexes, F.lit(0)).when(b32, F.lit(1)).otherwise(F.lit(2))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(hexes, lower).otherwise(core).alias("core"), kind.alias("kind"))

    def coded(s: Column) -> Column:
        letters = F.element_at(F.array(F.lit(HEX), F.lit(BASE32), F.lit(BASE64)), s["kind"] + 1)
        codes = F.transform(F.filter(F.split(s["core"], ""), lambda c: c != ""), lambda c: (F.instr(letters, c) - 1).cast("double"))
        kinds = s["core"]  # runs of one kind of letter become one letter; marks are passed over
        for pattern, one in (("[+/]", ""), ("[a-z]+", "."), ("[A-Z]+", ":"), ("[0-9]+", ";")):
            kinds = F.regexp_replace(kinds, pattern, one)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), codes.alias("codes"), F.length(letters).cast("double").alias("a"), F.size(codes).cast("double").alias("n"),
            (F.length(kinds) - 1).cast("double").alias("changes"), size(s["core"], "[^0-9]").alias("digits"), size(s["core"], "[^a-zA-Z]").alias("alphas"),
        )

    def summed(s: Column) -> Column:
        codes, n = s["codes"], s["n"]
        squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(codes, lambda x: x == c)), F.lit(2.0)))
        up = F.transform(codes, lambda x: F.when(x >= s["a"] / 2, 1.0).otherwise(0.0))
        mean = F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + x) / n
        keep = [s[c].alias(c) for c in ("start", "end", "kind", "codes", "a", "n", "changes", "digits", "alphas")]
        return F.struct(*keep, (squares * s["a"] / n - n).alias("chi"), up.alias("up"), mean.alias("mean"))

    def judged(s: Column) -> Column:
        a, n, codes, up, mean, chi = (s[c] for c in ("a", "n", "codes", "up", "mean", "chi"))
        high = F.aggregate(up, F.lit(0.0), lambda acc, x: acc + x)
        steps = F.sequence(F.lit(1), F.size(codes) - 1)
        runs = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc + F.when(up[i] != up[i - 1], 1.0).otherwise(0.0))
        lag = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + (codes[i] - mean) * (codes[i - 1] - mean))
        var = F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        keep = [s[c].alias(c) for c in ("start", "end", "kind", "a", "n", "changes", "digits", "alphas", "chi")]
        return F.struct(*keep, high.alias("high"), runs.alias("runs"), lag.alias("lag"), var.alias("var"))

    def concluded(s: Column) -> Column:
        a, n, chi, high, runs, lag, var, kind = (s[c] for c in ("a", "n", "chi", "high", "runs", "lag", "var", "kind"))
        df, low = a - 1, n - high
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        expected = 1 + 2 * high * low / n
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        z_runs = F.when((high == 0) | (low == 0), F.lit(9.0)).otherwise(F.abs(runs - expected) / spread)
        z_lag = F.when(var == 0, F.lit(9.0)).otherwise(F.abs(lag / var) * F.sqrt(n))
        p = F.least(_normal_tail(z_chi), 2 * _normal_tail(z_runs), 2 * _normal_tail(z_lag))
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), kind + 1)
        uneven = a * of(TEXT_CONCENTRATION) - 1
        z_text = (chi - (df + n * uneven)) / F.sqrt(2 * (df + 2 * n * uneven))
        z_changes = 2 * (F.sqrt(s["changes"]) - F.sqrt(of(TEXT_CHANGES) * (n - 1)))
        fits = F.when(kind == 0, s["alphas"] * -math.log(HEX_LETTERS)).when(kind == 1, s["digits"] * -math.log(BASE32_DIGITS)).otherwise(F.lit(0.0))
        total = log_tail(_normal_tail(-z_text)) + log_tail(_normal_tail(z_changes)) + F.least(fits, F.lit(27.6))
        size = F.lit(len(LENGTH_CLASSES))
        for k, end in reversed(list(enumerate(LENGTH_CLASSES))):
            size = F.when(n <= end, F.lit(k)).otherwise(size)
        worded = F.exp(-total) * (1 + total + total * total / 2)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), size.alias("length_class"), F.least(3 * p, F.lit(1.0)).alias("random"), worded.alias("worded"))

    # a secret mixes letters and digits; plain words and plain numbers are left to the patterns
    mixed = F.filter(found, lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]"))
    for step in (encoded, coded, summed, judged, concluded):
        mixed = F.transform(mixed, step)
    return mixed


def candidates(text: Column) -> Column:
    """Array of (start, end, length_class, random, worded) of the strings that the battery has tested, in the row of their text.

    ``random``: the least of three tests' p-values, times three: chi-squared for equal shares of the inferred
    alphabet, runs above and below its middle letter, and correlation of neighbours. ``worded``: how well written
    text would explain the string, by three tests of the same alphabet whose p-values Fisher's rule joins: the lower tail of
    the chi-squared value if letters are as uneven as in words, changes of letter kind as rare as in
    words, and letters or digits that only by chance all fit hex or base32. A random string gets less with length.
    """
    return _tests(_spans(text, CANDIDATE, "random", 0, 20))


def thresholds(tested: DataFrame, rate: float) -> dict[int, float]:
    """For each length class the largest p-value of ``worded`` that Benjamini and Hochberg's rule lets pass.

    p-values are counted in 200 steps of their logarithm, rounded up, so a few
    thousand counts at most come to the driver, whatever the corpus.
    """
    step = F.least(F.floor(-F.log10(F.greatest("worded", F.lit(1e-20))) * 10), F.lit(200)).cast("int")
    counts = tested.groupBy("length_class", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for k in {r["length_class"] for r in counts}:
        own = sorted(((r["step"], r["n"]) for r in counts if r["length_class"] == k), reverse=True)
        total, below = sum(n for _, n in own), 0
        for s, n in own:
            below += n
            if (p := 10 ** (-s / 10)) <= rate * below / total:
                out[k] = p
    return out


def scan_secrets(docs: DataFrame, rate: float = 0.01, random_level: float = 0.001) -> DataFrame:
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    The patterns' spans always stay. A tested string is added (kind ``random``)
    where no pattern's span overlaps it, the battery does not reject
    randomness at ``random_level``, and written text is rejected with false
    discoveries held at ``rate`` within its length class. Texts are read twice, and no row meets another: every
    row, of whatever doc_id, has the spans of its own text. Null and empty texts have none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    limits = thresholds(docs.select(F.explode(candidates(text)).alias("t")).select("t.*"), rate)
    limit = lambda t: functools.reduce(lambda out, kp: F.when(t["length_class"] == kp[0], F.lit(kp[1])).otherwise(out), limits.items(), F.lit(-1.0))
    base = F.array_sort(F.concat(*[_spans(text, p, k, g, least) for k, p, g, least in PATTERNS]))
    rows = docs.select("doc_id", base.alias("base"), candidates(text).alias("extra"))
    extra = F.filter("extra", lambda t: (t["worded"] <= limit(t)) & (t["random"] >= random_level))
    span = lambda s, kind: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"))
    rows = rows.select("doc_id", F.transform("base", lambda s: span(s, s["kind"])).alias("base"), F.transform(extra, lambda s: span(s, F.lit(KINDS.index("random")))).alias("extra"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    rows = rows.withColumn("extra", F.expr("filter(extra, x -> not exists(base, b -> b.start < x.end and x.start < b.end))"))
    rows = rows.withColumn("all", F.array_sort(F.concat("base", F.coalesce("extra", none))))
    named = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k, *_ in PATTERNS],
        F.sha2(F.concat_ws(",", F.transform("base", named)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("all", named)).alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_random"),
    )
