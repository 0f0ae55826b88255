import itertools
import zlib

import numpy as np

from tidewell.llm import quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lens = np.array([1, 5, 3, 1, 6])
    u, t = rng.normal(size=lens.sum()), rng.normal(size=(2, 2))
    f, b = quality.chain(u, lens, t)
    at = 0
    for n in lens:
        own = u[at : at + n]
        mass = np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(t[a, c] for a, c in itertools.pairwise(y)))
            for i in range(n):
                mass[i, y[i]] += p
        assert np.allclose(f[at : at + n] + b[at : at + n], np.log(mass[:, 1] / mass[:, 0]))
        at += n


def test_small_cells_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    lens = rng.integers(1, 9, 40)
    u, t = rng.normal(size=lens.sum()), rng.normal(size=(2, 2))
    want = quality.chain(u, lens, t)
    monkeypatch.setattr(quality, "CELLS", 5)
    got = quality.chain(u, lens, t)
    assert np.allclose(want, got)


def test_features_of_odd_texts():
    texts = ["", "\n", "\n\n", "a", "É\n\nx y x", "word " * 3000, "\r\n\t"]
    x, size, lens = quality.featurise(texts)
    assert lens.tolist() == [t.count("\n") + 1 for t in texts] and len(x) == lens.sum() and np.isfinite(x).all()
    assert size.tolist() == [len(line.encode()) for t in texts for line in t.split("\n")]
    one = [quality.featurise([t])[0] for t in texts]
    assert np.allclose(np.concatenate(one), x)


def test_table(spark):
    good = "This is a fine sentence with many words. And here is another one of them."
    bad = "BUY!!! NOW### $$$ CLICK"
    rows = [(i, (good if i % 3 else bad) + f" {i}", "en") for i in range(300)] + [(None, None, "x"), (900, "", "y"), (1, good + " 1", "en"), (901, "w " * 90000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, "q") for i in range(300)] + [(5, 0, ""), (None, 1, ""), (7, None, "")], "doc_id long, quality int, text string")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 300:
            assert r.predicted == int(r.doc_id % 3 > 0)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {1.0}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.classify(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.95


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = (sorted((r.doc_id, r.score) for r in quality.classify(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_a_text_goes_to_a_worker_once_and_comes_back_in_slices(spark):
    docs = spark.range(0, 2500, numPartitions=1).selectExpr("id AS doc_id", "'one line' AS text")
    field = quality.LineField.always(0.5)
    out = quality.score(docs, field)
    plan = out._jdf.queryExecution().analyzed().toString()
    line = plan[plan.index("MapInArrow") :].split("\n")[1]
    assert line.count(" AS c") == len(docs.columns)
    assert out.count() == 2500 and {r["__score"] for r in out.collect()} == {0.5}
    numbers = docs.selectExpr("doc_id", "doc_id AS text")  # a text of another type is cast, and its column stays as it is
    assert sorted(tuple(r) for r in quality.score(numbers, field).collect()) == [(i, i, 0.5) for i in range(2500)]
