"""Quality rules on cross-document line frequency, in DataFrame expressions only.

A line is normalised (lower case, white space runs to one space, trimmed) and hashed; per host (`source`) the
distinct documents (doc_ids) that hold it are counted over the whole table. A line in more than LEAST documents of
a host is boilerplate and removed, however large the host; a document left with less than LEFT of its words is
depleted and rejected. Base rules on each text come first (see base_measures).

A document is a doc_id; a row with a null doc_id is one of its own. Texts are read once: base measures and the hashed lines
of each row are written with a row number, from which lines are counted and joined, so each row is judged by its own lines.

Edge cases: null or empty text has zero counts and fails the base rules; null hosts form one host; very long texts
are used whole; an empty table gives an empty result; equal rows get equal results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraline.llm.shared import cut

LEAST, LEFT = 5, 0.3
GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAPS))


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def base_measures(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, and further columns."""
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, SPACES, "")
    out = docs.select("doc_id", *columns, F.length(bare).cast("long").alias("word_chars"), (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                      lines_of(text).alias("lines"), F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("words"))
    window = lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(5)])
    out = out.withColumns({"n_words": F.size("words").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
                           "windows": F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(0), F.size("words") - 5), window))}).drop("lines", "words")
    rest = [c for c in out.columns if c != "windows"]
    out = out.select(
        *rest,
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("ordered"),
    )
    same = lambda x, j: F.coalesce(F.get("ordered", j)["h"] == x["h"], F.lit(False))
    out = out.select(*rest, F.array_sort(F.transform(F.filter("ordered", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])).alias("starts"))
    return out.select(
        *rest,
        F.coalesce(
            F.aggregate(F.transform("starts", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("starts", i + 1), p + 5) - p)), F.lit(0), lambda a, x: a + x),
            F.lit(0),
        ).cast("long").alias("n_repeat_words"),
    )


def frequent_lines(lines: DataFrame, least: int = LEAST) -> DataFrame:
    """(host, line) in more than `least` documents of the host, from rows (doc_id, row, host, line)."""
    # rows of a line bound its documents from above: only lines in too many rows have their documents counted
    many = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("host", "line")
    own = F.when(F.col("doc_id").isNull(), F.col("row")).alias("own")
    documents = lines.join(many, ["host", "line"], "left_semi").select("host", "line", "doc_id", own).distinct()
    return documents.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("host", "line")


def host() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("host")


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), GAPS, " "))


def line_words(text: Column) -> Column:
    """(line, n) of each line that holds a word: the hash of the normalised line and its words."""
    return F.transform(lines_of(text), lambda x: F.struct(F.xxhash64(normal(x)).alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n")))


def exploded(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "row", "host", F.explode("hashed").alias("x")).select("doc_id", "row", "host", "x.line", "x.n")


def quality(docs: DataFrame, least: int = LEAST, left: float = LEFT) -> DataFrame:
    """The base measures of each text, base_failed, n_frequent_words (in removed lines) and kept."""
    # the row number is written with the rows and read from there: a later run of a lost task can't change it
    rows = cut(base_measures(docs, host(), line_words(F.col("text")).alias("hashed"), F.monotonically_increasing_id().alias("row")), "measured")
    lines = exploded(rows)
    lost = lines.join(frequent_lines(lines, least), ["host", "line"], "left_semi").groupBy("row").agg(F.sum("n").alias("n_frequent_words"))
    out = (
        rows.drop("hashed")
        .join(lost, "row", "left")
        .drop("row", "host")
        .withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0).cast("long")))
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_frequent_words") >= left * F.col("n_words")))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
l AS (SELECT row, doc_id, host, unnest(lines) AS raw FROM w),
n AS (SELECT row, doc_id, host, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n FROM l),
f AS (SELECT host, line FROM n GROUP BY host, line HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'row ' || row)) > 5),
lost AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_frequent_words FROM n JOIN f USING (host, line) GROUP BY row),
p AS (SELECT row, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
r AS (SELECT row, i, count(*) OVER (PARTITION BY row, array_to_string(list_slice(words, i, i + 4), ' ')) AS times FROM p),
c AS (SELECT row, count(DISTINCT i + j) AS n_repeat_words FROM r, range(5) t(j) WHERE times > 1 GROUP BY row),
b AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_frequent_words, 0) AS n_frequent_words FROM w LEFT JOIN c USING (row) LEFT JOIN lost USING (row))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_frequent_words >= 0.3::DOUBLE * n_words AS kept FROM b
"""


def clean_texts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the lines that are too frequent on their host taken out of the text."""
    names = ["doc_id", "text", "host"]
    rows = cut(
        docs.select(
            "doc_id", F.xxhash64("text").alias("text"), host(), line_words(F.col("text")).alias("hashed"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "lines",
    )
    bad = exploded(rows).join(frequent_lines(exploded(rows), least), ["host", "line"], "left_semi").select("row", "line")
    bad = (
        rows.select("row", *names)
        .join(bad, "row")
        .groupBy(*names)
        .agg(F.collect_set("line").alias("bad"))
    )  # no more than a text has lines
    mine = [F.col("d.doc_id"), F.xxhash64("d.text"), F.coalesce(F.concat(F.lit("="), F.col("d.source")), F.lit(""))]
    on = [a.eqNullSafe(F.col(f"b.{n}")) for a, n in zip(mine, names, strict=True)]
    stays = lambda x: ~F.coalesce(F.array_contains("b.bad", F.xxhash64(normal(x))), F.lit(False))
    text = F.array_join(F.filter(F.split("d.text", "\n"), stays), "\n")
    out = docs.alias("d").join(bad.alias("b"), on[0] & on[1] & on[2], "left")
    return out.select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
