"""Benchmark decontamination over a distributed positional inverted index, in built-in functions only.

Words are what is left between ASCII characters that aren't letters or digits, with A-Z lowered.
A benchmark item gives all windows of `width` consecutive words, or one shorter window if it has
fewer. The index holds postings (document, term, position) of the words that the windows need:

1. The corpus is read and the postings of every benchmark word are counted, which ranks each window's words.
2. Postings of the `RARE` rarest words of every window are stored. Each posting of a window's rarest word
   names a candidate start; the lists of its next words, less their offsets, are intersected with that.
3. Postings of all other words, whose lists are the longest, are stored only for documents in which a
   candidate is left, and those lists are intersected in the same way.

A position serves a word if it lies within `slop` of where the word stands in the window. A candidate is exact
if all its words stand at start, start + 1, ...; it is a proximity match if some start has every word within
`slop` places of its own. Which starts are still possible is a mask of bits, so both kinds come from one pass.

Documents are known by a 128-bit hash of their text, so copies share one set of matches; postings meet by
document, term and block of `BLOCK` positions, so neither a group of copies, nor a common word, nor a very
long text makes a large group. Of equally frequent words the first in alphabetical order leads, then the
least offset, which changes no match. Null and empty texts have no words and no hits;
items with null or empty text have no windows; items with a null id hit words but aren't listed.
Repeated documents give repeated rows, repeated items count once. Columns besides the ids and
texts aren't read. An empty table on either side gives the plain result: no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewell.llm.common import ascii_lower, content_key, cut, q

#: Between words: ASCII except digits and a-z. Fixed by the contract.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
#: Words of a window whose postings are stored at once, and positions in a block under which postings meet.
RARE, BLOCK = 3, 64
#: The benchmark's words and windows are broadcast up to so many rows and joined by shuffle beyond.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP), "")


def windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, phrase: array of words), one row per item and distinct window."""
    w = items.select(q(id_col).alias("item_id"), words(q(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("phrase")).distinct()


def _sized(df: DataFrame) -> DataFrame:
    """df under a broadcast hint if a count proves it small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _mask(d: Column, slop: int) -> Column:
    """Bits of the starts, from -slop to slop around a candidate's, that a posting d places off its word's place allows."""
    full = F.lit((1 << (2 * slop + 1)) - 1)
    return F.when(d >= 0, F.call_function("shiftleft", full, d).bitwiseAND(full)).otherwise(F.call_function("shiftright", full, -d))


def _intersect(candidates: DataFrame, places: DataFrame, postings: DataFrame, lo: int, hi: int, slop: int) -> DataFrame:
    """The candidates (k1, k2, p, start, length, mask, exact) that the lists of their words ranked lo to hi - 1 leave."""
    wanted = candidates.join(_sized(places.filter((F.col("rank") >= lo) & (F.col("rank") < hi))), "p").withColumn("at", F.col("start") + F.col("offset"))
    first, last = (F.floor((F.col("at") + x * 2 * slop) / BLOCK) for x in (-1, 1))
    wanted = wanted.withColumn("block", F.explode(F.array_distinct(F.array(first, last)))) if slop else wanted.withColumn("block", first)
    d = (F.col("pos") - F.col("at")).cast("int")
    met = wanted.join(postings.withColumn("block", F.floor(F.col("pos") / BLOCK)), ["k1", "k2", "t", "block"]).filter(F.abs(d) <= 2 * slop)
    of = lambda k, x: F.when(F.col("rank") == k, x)
    found = met.groupBy("k1", "k2", "p", "start").agg(
        F.first("length").alias("length"), F.first("mask").alias("mask"), F.first("exact").alias("exact"),
        *[x for k in range(lo, hi) for x in (F.bit_or(of(k, _mask(d, slop))).alias(f"m{k}"), F.max(of(k, d == 0)).alias(f"e{k}"))],
    )
    mask, exact = F.col("mask"), F.col("exact")
    for k in range(lo, hi):  # a shorter window has no such word
        mask = mask.bitwiseAND(F.when(F.col("length") > k, F.coalesce(f"m{k}", F.lit(0))).otherwise(-1))
        exact = exact & F.when(F.col("length") > k, F.coalesce(f"e{k}", F.lit(False))).otherwise(True)
    return found.select("k1", "k2", "p", "start", "length", mask.alias("mask"), exact.alias("exact")).filter("mask <> 0")


def index_and_match(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(heads, matches).

    heads: a row per document: its id, k1, k2 (the text's identity) and n_words.
    matches: distinct (k1, k2, start, length, item_id, exact): with exact, the window's words stand at
    start, start+1, ...; without (only if slop > 0), it is a proximity match around that start.
    """
    w = cut(windows(items, width))
    phrases = cut(w.select("phrase").distinct().withColumn("p", F.monotonically_increasing_id()))
    vocabulary = cut(phrases.select(F.explode("phrase").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()))
    texts = docs.select(q(id_col).alias("doc_id"), q(text_col).cast("string").alias("text"))
    k1, k2 = content_key(F.col("text"))
    counts = texts.select(F.explode(words(F.col("text"))).alias("term")).join(_sized(vocabulary), "term").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    # A window with a word that the corpus never has cannot occur; the words of the others are ranked, the rarest first.
    placed = phrases.select("p", F.posexplode("phrase").alias("offset", "term")).join(vocabulary, "term").join(cut(counts), "t", "left")
    ranked = placed.groupBy("p").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset", "t"))).alias("all")).filter("all[0].n > 0")
    places = cut(ranked.select("p", F.size("all").alias("length"), F.posexplode("all").alias("rank", "x")).select("p", "length", "rank", "x.offset", "x.t"))
    terms = lambda of: _sized(places.filter(of).select("t").distinct().join(vocabulary, "t"))
    rare = F.col("rank") < RARE
    found = (
        texts.select("doc_id", k1.alias("k1"), k2.alias("k2"), words(F.col("text")).alias("w"))
        .select("doc_id", "k1", "k2", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "term"))
        .join(terms(rare), "term", "left").filter("t is not null or pos = 0 or pos is null")
        .select("doc_id", "k1", "k2", "n_words", "pos", "t")
    )
    found = cut(found)
    heads = found.filter("pos = 0 or pos is null").select("doc_id", "k1", "k2", "n_words")
    postings = found.filter("t is not null").select("k1", "k2", "t", "pos").distinct()
    lead = places.filter("rank = 0").drop("rank")
    full = F.lit((1 << (2 * slop + 1)) - 1)
    start = F.col("pos") - F.col("offset")
    begun = postings.join(_sized(lead), "t").select("k1", "k2", "p", start.alias("start"), "length", full.alias("mask"), F.lit(True).alias("exact"))
    if not slop:
        begun = begun.filter("start >= 0")
    single = begun.filter("length = 1")
    left = cut(_intersect(begun.filter("length > 1"), places.filter("length > 1").drop("length"), postings, 1, RARE, slop).unionByName(single))
    more = left.filter(F.col("length") > RARE)
    there = _sized(more.select("k1", "k2").distinct())
    others = texts.select(k1.alias("k1"), k2.alias("k2"), "text").join(there, ["k1", "k2"], "left_semi").select("k1", "k2", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    others = others.join(terms(~rare), "term").select("k1", "k2", "t", "pos").distinct()
    whole = left.filter(F.col("length") <= RARE)
    if width > RARE:
        whole = whole.unionByName(_intersect(more, places.drop("length"), others, RARE, width, slop))
    listed = w.join(phrases, "phrase").select("p", "item_id")
    return heads, whole.join(_sized(listed), "p").select("k1", "k2", "start", "length", "item_id", "exact").distinct()


def covered(matches: DataFrame) -> DataFrame:
    """(k1, k2, n_hit): words inside any exact match, each counted once."""
    spans = matches.filter("exact").groupBy("k1", "k2", "start").agg((F.col("start") + F.max("length")).alias("end"))
    before = W.partitionBy("k1", "k2").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    return spans.select("k1", "k2", fresh.alias("fresh")).groupBy("k1", "k2").agg(F.sum("fresh").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (see the module's text).

    With slop also n_near: how many items have a window within slop places of its words' own, exact ones among them.
    """
    heads, matches = index_and_match(docs, items, width, slop, id_col, text_col)
    matches = cut(matches)
    listed = matches.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("items"), F.count_distinct("item_id").alias("near"))
    found = listed.join(covered(matches), ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast(T.ArrayType(T.StringType())))
    return heads.join(found, ["k1", "k2"], "left").select(
        F.col("doc_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *([F.coalesce("near", F.lit(0)).alias("n_near")] if slop else []),
    )


#: The slop that the query reports proximity matches for.
NEAR = 1


#: The same rows by comparing every document window with every benchmark window of its length, and n_near by trying every start in documents with all words of a window.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS p FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS p FROM di),
m AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS spot FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id),
ps AS (SELECT p, ws, list_reduce(ws, lambda x, y: CASE WHEN len(y) > len(x) THEN y ELSE x END) AS longest FROM (SELECT DISTINCT p, string_split(p, ' ') AS ws FROM bw)),
dd AS (SELECT doc_id, w, unnest(list_distinct(w)) AS longest FROM d),
ca AS (SELECT doc_id, p, ws, w FROM dd JOIN ps USING (longest) WHERE list_has_all(w, ws)),
st AS (SELECT doc_id, p, ws, w, unnest(range(-1, len(w) + 1)) AS s FROM ca),
ne AS (SELECT DISTINCT doc_id, p FROM st WHERE list_bool_and(list_transform(range(1, len(ws) + 1), lambda j: list_contains(w[greatest(s + j - 1, 1):s + j + 1], ws[j])))),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM ne JOIN bw USING (p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
