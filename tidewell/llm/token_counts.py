"""Token counts from an exact length histogram.

Documents are aggregated by their encoded length; suffix sums over the histogram then answer, for
any context limit, how many documents reach it, how many tokens there are in all and how many are
left after truncation, and any quantile of length. The histogram has at most as many rows as there are
distinct lengths; its suffix sums are taken in blocks of `BLOCK` lengths, whose totals are summed in
turn, so no task holds more than a block or the list of blocks.

Tokens are those of a byte-level BPE given as ranks. Null text counts as empty and has length 0.
Extra columns aren't read; repeated rows count repeatedly; an empty table gives an empty histogram.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.llm.common import cut

BLOCK = 4096


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_lengths(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row's whole text."""
    import public_tokenizers

    with open(ranks_path or default_ranks(), "rb") as f:
        ranks = f.read()
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches):
        import pyarrow as pa

        encode = _encoder(ranks, pattern).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t.as_py() or "")) for t in b.column(1)], pa.int64())], names=[id_col, "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs) for each distinct length."""
    return lengths.groupBy(F.col(col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with what every context limit equal to one of its lengths needs.

    docs_at_least, tokens_at_least: documents of that length or more, and their tokens; total_docs,
    total_tokens: of all; truncated_tokens: what is left if each document keeps its first n_tokens;
    share_at_most: share of documents that fit; quantile q is the least n_tokens with share_at_most >= q.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("mass", F.col("n_tokens") * F.col("n_docs"))
    upward = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("mass").alias("m"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(upward), F.lit(0)).alias("d_above"), F.coalesce(F.sum("m").over(upward), F.lit(0)).alias("m_above"))
    all_of = hist.agg(F.sum("n_docs").alias("total_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("total_tokens"))
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    s = h.join(blocks, "block").crossJoin(F.broadcast(all_of))  # one row
    d, m = F.sum("n_docs").over(inside) + F.col("d_above"), F.sum("mass").over(inside) + F.col("m_above")
    s = s.select("n_tokens", "n_docs", d.alias("docs_at_least"), m.alias("tokens_at_least"), "total_docs", "total_tokens")
    longer = F.col("docs_at_least") - F.col("n_docs")
    short = F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("n_docs")
    return s.select("*", (short + F.col("n_tokens") * longer).alias("truncated_tokens"), (1 - longer / F.col("total_docs")).alias("share_at_most"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row, even over an empty table, for any limit: docs_over, docs_fitting, total_tokens, truncated_tokens."""
    over = F.col("n_tokens") > limit
    n = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return sums.agg(
        n(F.when(over, F.col("n_docs"))).alias("docs_over"), n(F.when(~over, F.col("n_docs"))).alias("docs_fitting"),
        n(F.col("n_docs") * F.col("n_tokens")).alias("total_tokens"), n(F.col("n_docs") * F.least("n_tokens", F.lit(limit))).alias("truncated_tokens"),
    )


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least a share q of the documents doesn't exceed; None over an empty table."""
    return sums.filter(F.col("share_at_most") >= q - 1e-12).agg(F.min("n_tokens")).first()[0]


def report(docs: DataFrame) -> DataFrame:
    """suffix_sums() of the documents; the histogram is read several times and so written once."""
    return suffix_sums(cut(histogram(token_lengths(docs))))
