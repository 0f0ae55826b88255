import hashlib

import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql.functions import lit as pyspark_lit
from test_decontam import brute as brute_hits
from test_simhash import brute as brute_groups

from tidewell.llm import lines, pieces, quality


def test_stages_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{sf_small}/labels.parquet")).collect() if r.predicted}
    kept = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    assert 0 < len(kept) < docs.count()
    frame = spark.createDataFrame(kept, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in lines.dedup_lines(frame).collect())  # has its own brute-force test
    groups = {i: c for i, _, c in brute_groups(kept)}
    kept = [(i, t) for i, t in kept if groups[i] == i]
    hits = {i: bad for i, *_, bad in brute_hits(kept, bench)}
    kept = [(i, t) for i, t in kept if not hits[i]]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = set()
    for i, t in kept:
        ids = sp.encode(t, add_eos=True)
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    rows = corpus_pipeline.run(spark, sf_small).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


@pytest.mark.parametrize("k", range(4))
def test_a_stage_returns_the_columns_of_documents(spark, sf_small, k):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    odd = docs.limit(20).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", None, "a", 0), (7, "", None, "a", 0)], docs.schema))
    for frame in (odd, docs.limit(0)):
        out = corpus_pipeline.STAGES[k][1](spark, frame, sf_small)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() <= frame.count()
    assert out.count() == 0


@pytest.mark.parametrize("k", range(4))
def test_clashing_dotted_and_long(spark, sf_small, k):
    """Columns named like the stages' own, a text far longer than others, ties and repeated rows."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(30)
    long = docs.first().text * 400
    more = spark.createDataFrame([(900, long, "en", "a", len(long)), (900, long, "en", "a", len(long)), (901, long, "en", "b", len(long))], docs.schema)
    odd = docs.unionByName(more)
    clash = ["__score", "__text", "__lines", "__lines_", "a.b", "row", "o", "h", "name", "k1", "term", "fp", "key"]
    wide = odd.select("*", *[pyspark_lit(i).alias(c) for i, c in enumerate(clash)])
    out = corpus_pipeline.STAGES[k][1](spark, wide, sf_small)
    assert out.columns == wide.columns
    rows = out.collect()
    assert all(tuple(r)[len(odd.columns) :] == tuple(range(len(clash))) for r in rows)
    want = sorted((r.doc_id, r.text) for r in corpus_pipeline.STAGES[k][1](spark, odd, sf_small).collect())
    assert sorted((r.doc_id, r.text) for r in rows) == want and len(want) > 0
    if k == 2:  # repeating a text keeps its fingerprint: the original has the least id
        assert not {900, 901} & {i for i, _ in want} and docs.first().doc_id in {i for i, _ in want}
