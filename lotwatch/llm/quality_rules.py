"""Quality rules: word statistics of each text, then lines that recur across a host's documents.

Native throughout.  Normalised lines are hashed; for each host (the source)
and line the distinct documents that hold it are counted, copies of one text
counting once; lines above the limit are taken away, and a document of which
too little is left is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import BLANKS, cut, once, table, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: A line of LONG_WORDS words or more is over the limit in more distinct documents of a host than this, however large the host.
LEAST_DOCS, LONG_WORDS = 10, 6
#: Lines of any length are over it in more than that and this share of the host's documents; only these reject a document.
SHARE = 0.1
#: A document is depleted if less than this share of its distinct lines' characters is left.
LEFT = 0.5


def repeated_words(df: DataFrame, by: str, out: str) -> DataFrame:
    """Words of array `by` inside a 3-word window that the array holds twice or more, as column `out`.

    Texts without a repeated window (as most are) end at comparing two sizes;
    the others sort (window, place) once.
    """
    w = F.col(by)
    last = F.size(w) - 3
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_windows", once(windows))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", once(F.when(some, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("at")))))))
    s = F.col("_sorted")
    places = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["at"]))
    df = df.withColumn("_places", F.sort_array(F.array_compact(places)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
    covered = F.aggregate("_places", start, lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(3), x - a["last"])).alias("sum")), lambda a: a["sum"])
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_windows", "_sorted", "_places")


def normalised(line: Column) -> Column:
    """Lower case, blanks collapsed, none at the ends."""
    return F.trim(F.lower(F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " ")))


def lines_of(text: Column) -> Column:
    """Distinct normalised lines as hash, length and number of words."""
    # Blanks after a line end change no normalised line: without them a run of millions of line ends makes no array.
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, r"\n[\x20\x09-\x0D]*", "\n"), "\n"), normalised), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).cast("long").alias("size"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words"))))


def keys(source: Column, text: Column) -> dict[str, Column]:
    """What names a document's text among those of its host."""
    return {"host": F.coalesce(source.cast("string"), F.lit("")), "copy": F.unhex(F.md5(F.coalesce(text, F.lit(""))))}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, copy, the word statistics, base_failed, the distinct lines and their chars of every row of docs, written: the one pass over texts that verdicts need."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[c.alias(k) for k, c in keys(F.col("source"), F.col("text")).items()])
    # Lines without a word go first, together where they stand together.
    plain = F.filter(F.split(F.regexp_replace("text", r"\n[\x20\x09-\x0D]*\n", "\n"), "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    base = rows.withColumns({"lines": once(lines_of(F.col("text"))), "words": once(words(F.col("text"))), "full_lines": plain})
    base = repeated_words(base, "words", "n_repeat_words").select(
        "doc_id",
        "host",
        "copy",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "lines",
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("chars"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return cut(base.withColumn("base_failed", failed))


def judged(base: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, left: float = LEFT, long_words: int = LONG_WORDS) -> DataFrame:
    """base (see measured) with removed_chars, gone_chars, kept, and the hashes of its lines that go.

    long_words: lines of so many words are above the limit in more than
    least_docs documents, whatever the share.  Those that aren't above the
    share too don't reject a document: where too little would be left without
    them, as in a group of near copies, they stay, for deduplication to judge.
    removed_chars are those that may reject it, gone_chars those that go.
    """
    # One further entry a document stands for the document itself.
    itself = F.struct(F.lit(None).cast("long").alias("line"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("words"))
    held = cut(base.select("host", "copy", F.explode(F.array_append("lines", itself)).alias("l")).select("host", "copy", "l.line", "l.size", "l.words").distinct())
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
    counts = cut(counts.filter((F.col("n") > least_docs) | F.col("line").isNull()))
    hosts = counts.filter("line is null").select("host", F.col("n").alias("documents"))
    common = counts.filter("line is not null").join(hosts, "host").withColumn("wide", F.col("n") > share * F.col("documents"))
    common = cut(common.filter(F.col("wide") | (F.col("words") >= long_words)).select("host", "line", "wide"))
    size, line = F.col("size"), F.col("line")
    gone = held.filter("line is not null").join(common, ["host", "line"]).groupBy("host", "copy")
    gone = cut(gone.agg(F.sum(F.when(F.col("wide"), size)).alias("removed_chars"), F.sum(size).alias("common_chars"), F.collect_list(F.when(F.col("wide"), line)).alias("gone"), F.collect_list(line).alias("common")))
    out = base.drop("lines").join(gone, ["host", "copy"], "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0)).cast("long"))
    spare = F.col("chars") - F.col("common_chars") >= left * F.col("chars")
    out = out.withColumn("gone_chars", F.when(spare, F.col("common_chars")).otherwise(F.col("removed_chars")).cast("long"))
    out = out.withColumn("gone", F.when(spare, F.col("common")).when(F.size("gone") > 0, F.col("gone")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("chars") - F.col("removed_chars") >= left * F.col("chars")))


def quality(docs: DataFrame, **limits: float) -> DataFrame:
    """doc_id, the word statistics, base_failed, kept, and the depletion's parts (chars, removed_chars, gone_chars) of every row of docs.

    A null or empty text has no words (and fails), a null source is a host of
    its own (""); a very long text counts whole; repeated rows each return a
    row, as do null ids; a line exactly at a limit stays; an empty table gives
    an empty result; other columns are ignored.  limits: those of judged().
    """
    return judged(measured(docs), **limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars", "removed_chars", "gone_chars")


def cleaned(docs: DataFrame, **limits: float) -> DataFrame:
    """The kept rows of docs without their lines above the limit, n_chars to match; other columns as they are, whatever their names.

    The rows are those that quality() keeps, so null and empty texts go, and
    the lines those of its gone_chars.  Verdicts hold for a text of a
    host, so that repeated rows share theirs; texts are shuffled once, to meet
    them; an empty table stays empty.
    """
    verdicts = judged(measured(docs), **limits).filter("kept")
    verdicts = cut(verdicts.groupBy("host", "copy").agg(F.first("gone").alias("gone")))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    out = rows.withColumns(keys(F.col("row.source"), F.col("row.text"))).join(verdicts, ["host", "copy"])
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(normalised(x)))), "\n")
    out = out.withColumn("left", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left))
    new = {"text": F.col("left"), "n_chars": F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("left")).cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


_WORDS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents
), w AS (SELECT rid, {_WORDS} AS w FROM d),
tri AS (
  SELECT rid, i, (w[i], w[i + 1], w[i + 2]) AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM tri) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
ln AS (
  SELECT DISTINCT rid, line FROM (
    SELECT rid, trim(unnest(string_split(lower(regexp_replace(text, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), chr(10)))) AS line FROM d)
  WHERE line <> ''
), held AS (SELECT DISTINCT d.host, d.text, ln.line FROM ln JOIN d USING (rid)),
hosts AS (SELECT host, count(DISTINCT text) AS documents FROM d GROUP BY host),
common AS (
  SELECT host, line, n > {SHARE} * documents AS wide FROM (SELECT host, line, count(*) AS n FROM held GROUP BY host, line) JOIN hosts USING (host)
  WHERE n > {LEAST_DOCS} AND (n > {SHARE} * documents OR length(line) - length(replace(line, ' ', '')) + 1 >= {LONG_WORDS})
), size AS (
  SELECT rid, CAST(sum(length(line)) AS BIGINT) AS chars,
         CAST(coalesce(sum(length(line)) FILTER (c.wide), 0) AS BIGINT) AS removed_chars,
         CAST(coalesce(sum(length(line)) FILTER (c.line IS NOT NULL), 0) AS BIGINT) AS common_chars
  FROM (SELECT ln.rid, ln.line, d.host FROM ln JOIN d USING (rid)) LEFT JOIN common c USING (host, line) GROUP BY rid
), full_lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(chars, 0) AS chars, coalesce(removed_chars, 0) AS removed_chars, coalesce(common_chars, 0) AS common_chars
  FROM d JOIN w USING (rid) JOIN full_lines USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN size USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND chars - removed_chars >= {LEFT} * chars AS kept,
  chars, removed_chars, CASE WHEN common_chars > 0 AND chars - common_chars >= {LEFT} * chars THEN common_chars ELSE removed_chars END AS gone_chars
FROM m
"""
