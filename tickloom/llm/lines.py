"""Line dedup: winnowed fingerprints of line runs, joined, extended both ways, later repeats deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spread_join, staged

#: A document: its id, its text's hash, and 0, or 1 for all further rows of the same id and text. Documents go in this order.
KEY = ["doc", "th", "copy"]
OTHER = ["o_doc", "o_th", "o_copy"]


def _named(docs: DataFrame) -> tuple[Column, Column]:
    """The id (nulls before all others) and the text's hash of a row."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def documents(docs: DataFrame, least_words: int) -> DataFrame:
    """Rows (doc, th, copy, lines) of documents with ``least_words`` words or more.

    ``lines`` has (line, h, words) of every line with words: number, hash, count of words.
    """
    doc, th = _named(docs)
    spaced = lambda s, i: F.struct(i.alias("line"), F.trim(F.regexp_replace(s, r"\s+", " ")).alias("s"))
    words = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1).cast("int")
    made = lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["s"]).alias("h"), words(x["s"]).alias("words"))
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), spaced)
    lines = F.transform(F.filter(lines, lambda x: x["s"] != ""), made)
    rows = docs.select(doc.alias("doc"), th.alias("th"), lines.alias("lines"))
    rows = rows.where(F.aggregate("lines", F.lit(0), lambda n, x: n + x["words"]) >= least_words)
    rows = rows.groupBy("doc", "th").agg(F.first("lines").alias("lines"), F.count(F.lit(1)).alias("n"))
    copies = F.when(F.col("n") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("doc", "th", F.explode(copies).alias("copy"), "lines")


def selected(arrays: DataFrame, least_words: int) -> DataFrame:
    """Rows (doc, th, copy, pos, at, end, h, words, sel) of lines; ``sel`` is the fingerprint (gram, pos) of the window from this line on.

    With k half of ``least_words``, each line starts a gram: the fewest lines from it on with k words. The least
    hash of the grams that start within k words of the line is selected, the first among equal ones. Words, grams
    and the choice depend on the ``least_words`` words behind the line's start only (whole lines), so runs of lines
    that are equal for so long select alike.
    """
    k = max(1, least_words // 2)
    by = W.partitionBy(*KEY)
    rows = arrays.repartition("doc", "th").select(*KEY, F.posexplode("lines").alias("i", "l"))
    rows = rows.select(*KEY, (F.col("i") + 1).alias("pos"), "l.h", "l.words")
    end = F.sum("words").over(by.orderBy("pos"))
    rows = rows.select(*KEY, "pos", (end - F.col("words")).cast("long").alias("at"), end.cast("long").alias("end"), "h", "words")
    run = by.orderBy("at").rangeBetween(0, k - 1)
    gram = F.when(F.sum("words").over(run) >= k, F.xxhash64(F.collect_list("h").over(run)))
    rows = rows.withColumn("gram", gram)
    near = by.orderBy("at").rangeBetween(0, least_words - k - 1)
    return rows.withColumn("sel", F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "pos"))).over(near)).drop("gram")


def windows(lines: DataFrame, least_words: int) -> DataFrame:
    """Rows (doc, th, copy, low, high, hash, sel) of ``selected`` lines' shortest runs of ``least_words`` words, from each line on and up to each line.

    ``sel`` is the fingerprint of the run's first line. A run of more words is the union of such runs inside it.
    """
    by = W.partitionBy(*KEY)
    on, back = by.orderBy("at").rangeBetween(0, least_words - 1), by.orderBy("end").rangeBetween(1 - least_words, 0)

    def run(w, low: Column, high: Column, sel: Column) -> Column:
        full = F.sum("words").over(w) >= least_words
        return F.when(full, F.struct(low.alias("low"), high.alias("high"), F.xxhash64(F.collect_list("h").over(w)).alias("hash"), sel.alias("sel")))

    rows = lines.select("*", run(on, F.col("pos"), F.max("pos").over(on), F.col("sel")).alias("on"))
    rows = rows.select(*KEY, "on", run(back, F.min("pos").over(back), F.col("pos"), F.first("sel").over(back)).alias("back"))
    rows = rows.select(*KEY, F.explode(F.filter(F.array("on", "back"), lambda x: x.isNotNull() & x["sel"].isNotNull())).alias("w"))
    return rows.select(*KEY, "w.*")


def _runs(matches: DataFrame, arrays: DataFrame, least: int) -> DataFrame:
    """Extends diagonals (document, other document, shift) both ways: rows (doc, th, copy, low, high) of equal runs of ``least`` words or more.

    A run ends at the first unequal line, so equal lines of the two documents on a diagonal are cut into maximal runs.
    """
    other = arrays.select(*[F.col(k).alias(o) for k, o in zip(KEY, OTHER)], F.col("lines.h").alias("g"))
    both = spread_join(matches, other, OTHER, [*KEY, "shift"]).join(arrays.select(*KEY, F.col("lines.h").alias("h"), F.col("lines.words").alias("words")), KEY)
    # positions are from 1; the line before the diagonal's first and after its last count as unequal
    low, high = F.greatest(F.lit(1), F.col("shift") + 1), F.least(F.size("h"), F.size("g") + F.col("shift"))
    both = both.withColumn("low", low).withColumn("high", high)
    folded = """aggregate(sequence(low, high + 1),
        named_struct('start', 0, 'words', 0L, 'out', cast(array() as array<struct<low:int,high:int>>)),
        (a, i) -> case when i <= high and h[i - 1] = g[i - 1 - shift]
            then named_struct('start', if(a.start = 0, i, a.start), 'words', a.words + words[i - 1], 'out', a.out)
            when a.start > 0 and a.words >= {least}
            then named_struct('start', 0, 'words', 0L, 'out', concat(a.out, array(named_struct('low', a.start, 'high', i - 1))))
            else named_struct('start', 0, 'words', 0L, 'out', a.out) end,
        a -> a.out)""".format(least=int(least))
    return both.where("low <= high").select(*KEY, F.explode(F.expr(folded)).alias("run")).select(*KEY, "run.low", "run.high").distinct()


def repeats(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """Rows (doc, th, first, later): the numbers (from 0) of lines in later repeats of runs of ``least_words`` words or more.

    A run is a row of neighbouring lines (those without words do not count); white space in a line counts as one
    space. Later is by (doc_id, hash of the text, line), so the first copy of every line stays. ``first`` holds for one row of
    this id and text, ``later`` for all its further ones.

    Fingerprints (``selected``) that several places hold are joined: a place to the place before it in its own document, else to
    the corpus's first. Each match is extended both ways. A window of ``least_words`` words that lies in no such run, and whose
    fingerprint has an earlier place, may still repeat another place: its hash is compared with those
    of all windows of that fingerprint. So each window is explained or compared, and no partner is capped.
    """
    arrays = staged(documents(docs, least_words), "lines")
    lines = selected(arrays, least_words)
    prints = staged(lines.where("sel is not null").select(*KEY, "sel.gram", "sel.pos").distinct(), "prints")
    place = F.struct(*KEY, "pos")
    shared = prints.groupBy("gram").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("gram", "f")
    shared = staged(spread_join(prints, shared, ["gram"], [*KEY, "pos"]), "shared")
    before = F.lag("pos").over(W.partitionBy("gram", *KEY).orderBy("pos"))
    matches = shared.withColumn("before", before).where(F.struct(*KEY, "pos") != F.col("f"))
    here = F.col("before").isNotNull()
    source = [F.when(here, F.col(k)).otherwise(F.col(f"f.{k}")).alias(o) for k, o in zip(KEY, OTHER)]
    shift = F.col("pos") - F.when(here, F.col("before")).otherwise(F.col("f.pos"))
    runs = staged(_runs(staged(matches.select(*KEY, *source, shift.alias("shift")).distinct(), "matches"), arrays, least_words), "runs")

    # windows whose fingerprint other places share
    own = arrays.join(shared.select(*KEY).distinct(), KEY, "left_semi")
    tried = windows(selected(own, least_words), least_words).select(*KEY, "low", "high", "hash", F.col("sel.gram").alias("gram"), F.col("sel.pos").alias("pos"))
    tried = staged(tried.join(shared.select(*KEY, "pos", (place == F.col("f")).alias("source")), [*KEY, "pos"]), "windows")
    inside = [F.col(f"w.{k}") == F.col(f"r.{k}") for k in KEY] + [F.col("r.low") <= F.col("w.low"), F.col("w.high") <= F.col("r.high")]
    open_ = tried.where("not source").alias("w").join(runs.alias("r"), inside, "left_anti").select("gram").distinct()
    tried = staged(spread_join(tried, open_, ["gram"], [*KEY, "low"]).select(*KEY, "low", "high", "hash"), "open")
    start = F.struct(*KEY, "low")
    first = tried.groupBy("hash").agg(F.min(start).alias("f"), F.max(start).alias("l")).where("f <> l").select("hash", "f")
    more = spread_join(tried, first, ["hash"], [*KEY, "low"]).where(F.struct(*KEY, "low") != F.col("f"))

    gone = runs.unionByName(more.select(*KEY, "low", "high"))
    gone = gone.select(*KEY, F.explode(F.sequence("low", "high")).alias("pos")).distinct()
    gone = gone.groupBy(*KEY).agg(F.array_sort(F.collect_list("pos")).alias("gone")).join(arrays, KEY)
    gone = gone.select(*KEY, F.expr("transform(gone, p -> lines[p - 1].line)").alias("gone"))
    copy = lambda k: F.first(F.when(F.col("copy") == k, F.col("gone")), ignorenulls=True)
    return gone.groupBy("doc", "th").agg(copy(0).alias("first"), copy(1).alias("later"))


def dedup_lines(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """``docs`` with ``text`` without repeated runs of lines (``repeats``), and ``n_lines``, ``n_removed``, ``removed`` (line numbers).

    Null texts stay null; a text whose lines all go is empty. Rows that repeat an id and a text are later copies of its
    first row, and lose all runs of ``least_words`` words; rows of one id and other texts are documents of their own. A null id
    comes before all others. Own columns of the new names are replaced.
    """
    docs = docs.drop("removed", "n_lines", "n_removed")
    doc, th = _named(docs)
    rows = docs.withColumn("_doc", doc).withColumn("_th", th)
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("_doc", "_th").orderBy("_th")))
    found = repeats(docs.select("doc_id", "text"), least_words).select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("first").alias("_first"), F.col("later").alias("_later"))
    rows = rows.join(found, ["_doc", "_th"], "left").withColumn("removed", F.when(F.col("_nth") == 1, F.col("_first")).otherwise(F.col("_later")))
    kept = F.expr("array_join(filter(transform(split(text, '\\n', -1), (s, i) -> if(array_contains(removed, i), null, s)), s -> s is not null), '\\n')")
    return rows.select(
        *[F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"),
    )


def without_repeats(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """``docs`` as ``dedup_lines`` leaves them, without those all of whose words were repeats; ``n_chars`` (where there is one) follows the text."""
    out = dedup_lines(docs, least_words)
    gone = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    out = out.where(~F.coalesce(gone, F.lit(False)))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out
