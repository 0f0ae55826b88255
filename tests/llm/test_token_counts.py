import math

import public_tokenizers
import pytest

from tidewell.llm import token_counts as tc


def lengths(texts):
    with open(tc.default_ranks(), "rb") as f:
        e = tc._encoder(f.read(), public_tokenizers.PATTERN)
    out = [e.encode_ordinary(t or "") for t in texts]
    assert all(e.decode(x) == (t or "") for x, t in zip(out, texts, strict=True))
    return [len(x) for x in out]


def brute(ns):
    out = []
    for n in sorted(set(ns)):
        out.append((n, ns.count(n), sum(x >= n for x in ns), sum(x for x in ns if x >= n), len(ns), sum(ns), sum(min(x, n) for x in ns), round(sum(x <= n for x in ns) / len(ns), 12)))
    return out


def rows(df):
    return sorted((*tuple(r)[:7], round(r.share_at_most, 12)) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 3])
def test_odd_texts(spark, monkeypatch, block):
    monkeypatch.setattr(tc, "BLOCK", block)
    texts = [None, "", "", "a", "a b c", "hello world " * 500, "<|endoftext|>", "É🙂", "a b c", "x" * 20000, "one two three four five"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 2)], "doc_id long, text string, n_tokens int")
    ns = lengths([*texts, "a"])
    sums = tc.report(docs)
    assert rows(sums) == brute(ns)
    for q in (0, 0.1, 0.5, 0.9, 1):
        assert tc.quantile(sums, q) == sorted(ns)[max(0, math.ceil(q * len(ns)) - 1)]
    for limit in (0, 1, 4, 10**6):
        assert tuple(tc.at_limit(sums, limit).first()) == (sum(n > limit for n in ns), sum(n <= limit for n in ns), sum(ns), sum(min(n, limit) for n in ns))
    empty = tc.report(docs.limit(0))
    assert empty.count() == 0 and tc.quantile(empty, 0.5) is None and tuple(tc.at_limit(empty, 5).first()) == (0, 0, 0, 0)


def test_corpus(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert rows(tc.report(docs)) == brute(lengths([r.text for r in docs.collect()]))
