"""Secret scans over an incremental blob ledger, in built-in functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger is a table of
(blob, rule_version, findings) in a folder; a scan looks only at pairs of blob and rule version that the ledger
lacks, each distinct blob once however many paths or versions hold it, appends them, and findings are
joined back to all paths from there. A blob's findings are stored as one array, empty ones included, so that
a clean blob isn't scanned again either. The rule version is derived from the rules themselves. Two writers
or a repeated append may leave a pair twice: reading collapses them, as equal pairs have equal findings.

A finding is (kind, start, end) in code points, end exclusive. Rules match leftmost and without
overlap; a match whose value is too short is dropped after it has consumed its text. Positions come
from the match boundaries that the regular-expression functions mark with U+0001 and U+0002, which
are first replaced in the text by U+FFFD (no rule matches any of the three, and lengths stay).

Null text counts as empty and has no findings. Repeated rows give repeated rows. Columns besides
the id and the text aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import held_out, let, new_path, prefix_sums, q


@dataclass(frozen=True)
class Rule:
    """pattern has two groups: what leads up to the value, and the value; at_least is the value's least length."""

    kind: str
    pattern: str
    at_least: int
    #: Only texts that hold this are searched: a cheap test of what every match must contain.
    needs: str


#: The base rules, in the order that breaks ties of position. Fixed by the contract.
BASE = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 12, "[:=]"),
    Rule("access", r"()(AKIA[A-Z0-9]+)", 18, "AKIA"),
    Rule("hex", r"()([0-9a-f]{16,})", 16, "[0-9a-f]{16}"),
)
#: What the method adds to them.
EXTRA = (
    Rule("pem", r"(-----BEGIN [A-Z ]{0,40})(PRIVATE KEY-----)", 1, "PRIVATE KEY"),
    Rule("jwt", r"()(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, r"eyJ"),
    Rule("forge", r"()(gh[pousr]_[A-Za-z0-9]+)", 40, "gh[pousr]_"),
)
RULES = BASE + EXTRA

FINDING = "struct<start:int,rank:int,end:int>"
LEDGER = f"blob string, findings array<{FINDING}>, rule_version string"
#: Increments in which the query's documents reach its ledger.
INCREMENTS = 2


def version(rules: tuple[Rule, ...]) -> str:
    """The rules' own version: any change of a rule or of their order is another one."""
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:16]


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """array of (start, rank, end) of one rule."""
    none = F.array().cast(T.ArrayType(T._parse_datatype_string(FINDING)))
    parts = F.split(F.regexp_replace(text, rule.pattern, "\x01$1\x02$2\x01"), "\x01")
    # Odd parts (from 0) are matches, each with one mark inside.
    places = lambda p: prefix_sums(F.transform(p, lambda x, k: F.length(x) - F.pmod(k, F.lit(2))))
    both = let(parts, lambda p: F.zip_with(p, places(p), lambda x, at: F.struct(x.alias("x"), at.cast("int").alias("at"))))
    long = F.filter(both, lambda y, k: (F.pmod(k, F.lit(2)) == 1) & (F.length(y["x"]) - F.instr(y["x"], "\x02") >= rule.at_least))
    found = F.transform(long, lambda y: F.struct(y["at"].alias("start"), F.lit(rank).alias("rank"), (y["at"] + F.length(y["x"]) - 1).alias("end")))
    return F.when(F.rlike(text, F.lit(rule.needs)), found).otherwise(none)


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    clean = F.when(F.rlike(text, F.lit("[\x01\x02]")), F.translate(text, "\x01\x02", "��")).otherwise(text)
    return F.array_sort(F.concat(*[_matches(clean, r, k) for k, r in enumerate(rules)]))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All (blob, findings, rule_version) rows that were appended at path."""
    return spark.read.schema(LEDGER).parquet(path)


def append(path: str, rows: DataFrame) -> None:
    rows.select("blob", "findings", "rule_version").write.mode("append").partitionBy("rule_version").parquet(path)


def known(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) under these rules, each blob once."""
    return ledger.filter(F.col("rule_version") == version(rules)).groupBy("blob").agg(F.first("findings").alias("findings"))


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, text) for every row."""
    text = F.coalesce(q(text_col).cast("string"), F.lit(""))
    return docs.select(q(id_col).alias("doc_id"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan_new(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows for (blob, text); equal blobs are brought together before they are scanned."""
    unseen = blobs.select("blob", "text")
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("rule_version") == version(rules)).select("blob"), "blob", "left_anti")
    return unseen.groupBy("blob").agg(F.first("text").alias("text")).select("blob", findings(F.col("text"), rules).alias("findings"), F.lit(version(rules)).alias("rule_version"))


def update(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Scans what the ledger at path lacks of docs and appends it there. A new path starts a ledger."""
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = read_ledger(spark, path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None
    append(path, scan_new(versions(docs, id_col, text_col), old, rules))


def lookup(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, findings) for every row of docs, from a ledger that knows its blob (null findings if it doesn't)."""
    # Clean blobs need no row of findings on the way back, only the proof that they were scanned.
    found = known(ledger, rules).withColumnRenamed("findings", "f")
    none = F.array().cast(f"array<{FINDING}>")
    short = found.select("blob", F.when(F.size("f") > 0, F.col("f")).alias("f"), F.lit(True).alias("scanned"))
    return versions(docs, id_col, text_col).select("doc_id", "blob").join(short, "blob", "left").select("doc_id", "blob", F.when(F.col("scanned"), F.coalesce("f", none)).alias("findings"))


def scan(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES, increments: int = INCREMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, findings) for every row of docs by way of the ledger at path (a new one in the shared folder if None).

    The rows reach the ledger in so many increments, by a hash of their ids; an increment scans only what those before left.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "ledger")
    for k in range(increments):
        update(docs.filter(held_out(q(id_col), increments, k)), path, rules, id_col, text_col)
    return lookup(docs, read_ledger(spark, path), rules, id_col, text_col)


def report(scanned: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from scan()'s rows."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    text = lambda x: F.array_join(F.transform(x, lambda f: F.concat_ws(":", F.element_at(kinds, f["rank"] + 1), f["start"].cast("string"), f["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("findings", lambda f: f["rank"] == k)).cast("long")
    return scanned.select(
        "doc_id", *[n(k).alias(f"n_{r.kind}") for k, r in enumerate(rules[:base])],
        F.sha2(text(F.filter("findings", lambda f: f["rank"] < base)), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"),
    )


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(RULES):
        marked = f"regexp_replace(t, {q(r.pattern)}, chr(1) || '\\1' || chr(2) || '\\2' || chr(1), 'g')"
        parts.append(f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, {r.at_least} AS least, string_split({marked}, chr(1)) AS p FROM d")
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(65533) || chr(65533)) AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT doc_id, rank, kind, least, p, unnest(range(1, len(p) + 1)) AS i FROM m WHERE len(p) > 1),
f AS (SELECT doc_id, rank, kind, i, p[i] AS s, least,
             coalesce(sum(length(p[i]) - CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, rank ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM e),
g AS (SELECT doc_id, rank, kind, a, a + length(s) - 1 AS b FROM f WHERE i % 2 = 0 AND length(s) - strpos(s, chr(2)) >= least),
r AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
             string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (doc_id)
"""


ORACLE = _oracle()
