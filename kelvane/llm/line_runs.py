"""Removing repeated runs of lines, found by winnowing line hashes. DataFrame operations only.

A text is its non-blank ``\\n``-split lines, each with a hash and a word count. A gram is the shortest run of lines
from a given one with GRAM words; a span is the shortest with SPAN words from a given line, or up to one. Winnowing
selects, for each span, the least gram hash inside it, so whatever repeats a span repeats its fingerprint. Positions
are joined on fingerprints that occur at more than one place; around those, matches are extended both ways by
comparing every span that holds the fingerprint with the first place where that span occurs. Spans that occurred
before (smaller doc_id, or the same document, earlier) are joined into maximal runs and deleted, with blank lines
inside them. So a line goes if and only if it lies in a run of lines with SPAN words or more that stands earlier as
well: in such a run, the span from the first line holds all lines before which the run has fewer than SPAN words, and
each other line is the last of a span inside the run.

Edge cases: a null text has no lines and stays null; a null doc_id comes before all others; texts with equal doc_id
are ordered by hash; repeated rows (equal doc_id and text) are one document and get the same result; short
documents, below SPAN words, are left alone; an empty table gives an empty result; a text of which nothing is left
becomes empty; columns other than doc_id and text pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, table, wrapped

SPAN, GRAM = 20, 10
WORD = r"[^\x20\x09-\x0D]+"


def spans_of(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Each span of each document, from a line or up to one: where it begins and ends, its two hashes, its fingerprint and where that stands."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "th", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("n")).filter("n > 0")
    doc = Window.partitionBy("doc_id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.withColumn("c", F.sum("n").over(doc) - F.col("n"))
    within = lambda words: Window.partitionBy("doc_id", "th").orderBy("c").rangeBetween(0, words - 1)
    short, long_ = within(gram), within(span)
    upto = Window.partitionBy("doc_id", "th").orderBy("c").rangeBetween(1 - span, 0)
    ahead = Window.partitionBy("doc_id", "th").orderBy("c").rangeBetween(Window.unboundedPreceding, -span)
    whole = F.when(F.sum("n").over(short) >= gram, F.struct(F.xxhash64(F.collect_list("h").over(short)).alias("g"), F.col("pos").alias("at"), F.max("c").over(short).alias("last")))
    grams = placed.withColumn("gram", whole)
    opener = F.last(F.struct("pos", "h", "h2", "gram")).over(ahead)
    found = grams.select("doc_id", "th", "pos", "c", *[f.alias(n) for n, f in {
        "end": F.max("pos").over(long_), "words": F.sum("n").over(long_), "hs": F.collect_list("h").over(long_), "h2s": F.collect_list("h2").over(long_), "gs": F.collect_list("gram").over(long_),
        "opener": opener, "closing": F.sum("n").over(upto), "bhs": F.collect_list("h").over(upto), "bh2s": F.collect_list("h2").over(upto), "bgs": F.collect_list("gram").over(upto),
    }.items()])

    def least(grams_: Column, last: Column) -> Column:
        return F.array_min(F.filter(grams_, lambda x: x["last"] <= last))

    def unit(start: Column, end: Column, hs: Column, h2s: Column, f: Column) -> Column:
        return F.struct(start.alias("pos"), end.alias("end"), F.xxhash64(hs).alias("s1"), F.xxhash64(h2s).alias("s2"), f["g"].alias("fingerprint"), f["at"].alias("at"))

    c = F.col
    onward = F.when(c("words") >= span, unit(c("pos"), c("end"), c("hs"), c("h2s"), least(c("gs"), c("c") + span - 1)))
    # the shortest run up to this line, unless the shortest from where that begins is the same
    first = c("opener")
    back_grams = F.concat(F.array(first["gram"]), c("bgs"))
    back = F.when(first.isNotNull() & (c("closing") < span), unit(first["pos"], c("pos"), F.concat(F.array(first["h"]), c("bhs")), F.concat(F.array(first["h2"]), c("bh2s")), least(back_grams, c("c"))))
    return found.select("doc_id", "th", F.inline(F.array_compact(F.array(onward, back))))


def repeated_runs(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, runs): for each document with any, its maximal runs of lines (start, end) that occurred before."""
    docs = docs.select("doc_id", "text")
    if not docs.groupBy("doc_id").count().filter("count > 1").limit(1).isEmpty():
        docs = docs.dropDuplicates()
    spans = cut(spans_of(docs, span, gram))
    place = F.struct("doc_id", "th", "at")
    # aggregates are written before they are joined: a join of plain tables can be split where one key has many rows
    shared = cut(spans.groupBy("fingerprint").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("fingerprint"))
    met = cut(spans.join(shared, "fingerprint").select("doc_id", "th", "pos", "end", "s1", "s2"))
    first = cut(met.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("s1", "s2", "first"))
    later = met.join(first, ["s1", "s2"]).filter(F.struct("doc_id", "th", "pos") != F.col("first")).select("doc_id", "th", "pos", "end")
    before = Window.partitionBy("doc_id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce((F.col("pos") > F.max("end").over(before) + 1).cast("int"), F.lit(1))
    upto = Window.partitionBy("doc_id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(upto))
    runs = runs.groupBy("doc_id", "th", "run").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def without_runs(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """row (all columns of ``docs``), runs (null where there are none) and kept: the text without its repeated runs."""
    runs = repeated_runs(docs, span, gram).select(F.col("doc_id").alias("id"), "th", "runs")
    joined = wrapped(docs).join(runs, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("th")), "left")
    lines = F.split("row.text", "\n", -1)
    # what stands before the first run, between two, and after the last
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["end"] + 1))
    ends = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.size("lines")))
    left = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: F.slice(F.col("lines"), g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0)))))
    joined = joined.select("row", "runs", F.when(F.col("runs").isNotNull(), lines).alias("lines"))
    return joined.select("row", "runs", F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")).alias("kept"))


def drop_repeated_lines(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs`` with their columns, the text (and n_chars, if there) as it is without repeated runs; texts that lose all words go."""
    found = without_runs(docs, span, gram)
    found = found.filter(F.col("runs").isNull() | F.col("kept").rlike(WORD))
    out = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("runs").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    return found.select(*[(out[c] if c in out else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.coalesce(F.aggregate("runs", F.lit(0), lambda t, r: t + r["end"] - r["start"] + 1), F.lit(0))
    return found.select(
        "row.doc_id", F.coalesce(F.size(F.split("row.text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed_lines"),
        F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long").alias("n_runs"),
        F.length(F.coalesce("kept", F.lit(""))).cast("long").alias("kept_chars"), F.md5(F.coalesce("kept", F.lit(""))).alias("kept_md5"),
    )


ORACLE = rf"""
WITH every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM every
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS c FROM counted WHERE n > 0
), spans AS (
  SELECT doc_id, pos, string_agg(line, chr(10)) OVER s AS body, sum(n) OVER s AS words, max(pos) OVER s AS last FROM placed
  WINDOW s AS (PARTITION BY doc_id ORDER BY c RANGE BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING)
), upto AS (
  SELECT doc_id, min(pos) OVER s AS pos, string_agg(line, chr(10)) OVER s AS body, sum(n) OVER s AS words, pos AS last FROM placed
  WINDOW s AS (PARTITION BY doc_id ORDER BY c + n RANGE BETWEEN {SPAN - 1} PRECEDING AND CURRENT ROW)
), later AS (
  SELECT doc_id, pos, max(last) AS last FROM (
    SELECT *, row_number() OVER (PARTITION BY way, md5(body) ORDER BY doc_id, pos) AS k
    FROM (SELECT 1 AS way, * FROM spans UNION ALL BY NAME SELECT 2 AS way, * FROM upto) WHERE words >= {SPAN}
  ) WHERE k > 1 GROUP BY doc_id, pos
), marked AS (
  SELECT e.doc_id, e.pos, e.line, coalesce(max(l.last) OVER (PARTITION BY e.doc_id ORDER BY e.pos), -1) >= e.pos AS gone
  FROM every e LEFT JOIN later l USING (doc_id, pos)
), edged AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM marked
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_removed_lines, CAST(sum(opens::INT) AS BIGINT) AS n_runs,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS BIGINT) AS kept_chars,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
FROM edged GROUP BY doc_id
"""
