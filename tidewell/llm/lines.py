"""Line dedup by a log-template tree of fixed depth, in built-in functions only.

A line is parsed down the tree by its number of tokens and its first `LEADING` tokens; runs of digits
have become <*> before that. Below, a leaf holds the line's template in full and up to three generalised
ones, in each of which one third of the remaining tokens (at least one token) is a variable field; a line of
up to `LEADING` tokens has nothing left to vary. A template recurs if lines of two or more documents share it.
The document with the least id keeps a recurring template's lines; in the others every line that belongs to
one is dropped, whatever the line's length and whatever share of the document that is. A later copy of a
document thus ends up empty. Lines without tokens have no template and stay, unless nothing else does.

Documents are told apart by id; null ids count as one document that comes last. Rows with one id and
text get the same result. Null text stays null and has no lines; empty text has one empty line.
Columns besides the id and the text pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import fresh, q

LEADING = 3
PARTS = 3
SPACE = r"[\x20\t\r\x0B\x0C]+"
OTHER_SPACE = r"[\t\r\x0B\x0C]"
LAST = (1 << 63) - 1


def _masked(text: Column) -> Column:
    """The whole text with runs of digits as <*> and every other white space but line ends as a space: a text at a time costs far less than a line at a time."""
    plain = F.when(F.rlike(text, F.lit(OTHER_SPACE)), F.regexp_replace(text, OTHER_SPACE, " ")).otherwise(text)
    return F.when(F.rlike(text, F.lit("[0-9]")), F.regexp_replace(plain, "[0-9]+", "<*>")).otherwise(plain)


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")  # a single character needs no regular expression


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = q(text_col).cast("string")
    return docs.select(F.struct("*").alias("row"), F.coalesce(q(id_col).cast("long"), F.lit(LAST)).alias("o"), F.xxhash64(text).alias("h"), text.alias("t"))


def template_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(o, h, no, k1, k2): a row for every template of every line that has tokens; k1 and k2 are a 128-bit hash of its fixed tokens and its shape."""
    lines = _located(docs, id_col, text_col).select("o", "h", F.posexplode(F.split(_masked(F.col("t")), "\n")).alias("no", "line"))
    tokens = lines.select("o", "h", "no", _tokens(F.col("line")).alias("tokens")).filter(F.size("tokens") > 0)
    # One row a template: tokens a + 1 to b are its variable field, and template -1, the full one, has none.
    # One small expression for all of them stays in code that the JVM compiles.
    n = F.size("tokens")
    at = lambda i: F.floor(F.greatest(n - LEADING, F.lit(0)) * i / PARTS).cast("int") + LEADING
    bound = lambda i: F.when(F.col("i") < 0, n).otherwise(at(i))
    each = tokens.select("*", F.explode(F.array(*[F.lit(i) for i in range(-1, PARTS)])).alias("i"))
    each = each.select("*", bound(F.col("i")).alias("a"), bound(F.col("i") + 1).alias("b")).filter("i < 0 or b > a")
    fixed = (F.col("i"), n, F.slice("tokens", 1, F.col("a")), F.slice("tokens", F.col("b") + 1, n))
    return each.select("o", "h", "no", F.xxhash64(*fixed).alias("k1"), F.xxhash64(F.lit("second"), *fixed).alias("k2"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(o, h, gone: array of distinct line numbers) for documents with recurring lines."""
    keyed = template_lines(docs, id_col, text_col)
    recurring = keyed.groupBy("k1", "k2").agg(F.min("o").alias("first"), F.max("o").alias("last")).filter("first < last").drop("last")
    hit = keyed.join(recurring, ["k1", "k2"]).filter("o > first").select("o", "h", "no").distinct()
    return hit.groupBy("o", "h").agg(F.collect_list("no").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with recurring lines dropped from the text; adds a last column of (n_lines, n_dropped), __lines unless docs has one of that name."""
    gone = dropped_lines(docs, id_col, text_col).withColumnsRenamed({"o": "o2", "h": "h2"})
    d = _located(docs, id_col, text_col)
    both = d.join(gone, (d.o == gone.o2) & d.h.eqNullSafe(gone.h2), "left")
    edit = F.col("gone").isNotNull()
    both = both.withColumn("lines", F.split("t", "\n"))
    # By position: array_except hashes, so the work is linear in the lines of a document.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    facts = F.struct(F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.when(edit, F.size("gone")).otherwise(0).cast("long").alias("n_dropped"))
    return both.select("row", F.when(edit, kept).otherwise(F.col("t")).alias("t"), facts.alias("facts")).select(
        *[(F.col("t") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns], F.col("facts").alias(fresh(docs, "__lines")),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the remaining text's SHA-256 (null for a null text)."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, text, coalesce(doc_id, {LAST}) AS o FROM documents),
s AS (SELECT doc_id, o, text, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT o, text, ls, unnest(range(1, len(ls) + 1)) AS no FROM s),
t AS (SELECT o, text, no, list_filter(string_split_regex(regexp_replace(ls[no], '[0-9]+', '<*>', 'g'), '{SPACE}'), lambda x: x <> '') AS t FROM l),
u AS (SELECT *, len(t) AS n FROM t WHERE len(t) > 0),
v AS (SELECT o, text, no, t, n, i, {LEADING} + ((n - {LEADING}) * i // {PARTS}) AS a, {LEADING} + ((n - {LEADING}) * (i + 1) // {PARTS}) AS b FROM u, (SELECT unnest(range(0, {PARTS})) AS i) WHERE n > {LEADING}),
k AS (SELECT o, text, no, 'full ' || n || ' ' || array_to_string(t, ' ') AS k FROM u
      UNION ALL SELECT o, text, no, i || ' ' || n || ' ' || array_to_string(t[1:a], ' ') || '|' || array_to_string(t[b + 1:], ' ') FROM v WHERE b > a),
r AS (SELECT k, min(o) AS first FROM k GROUP BY k HAVING min(o) < max(o)),
g AS (SELECT DISTINCT k.o, k.text, k.no FROM k JOIN r USING (k) WHERE k.o > r.first),
c AS (SELECT o, text, count(*) AS gone, list(no) AS nos FROM g GROUP BY o, text)
SELECT s.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_dropped,
       sha256(CASE WHEN gone IS NULL THEN s.text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(nos, i)), chr(10)) END) AS kept_sha256
FROM s LEFT JOIN c ON s.o = c.o AND s.text = c.text
"""
