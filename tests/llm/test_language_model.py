import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import language_model as lm


def small(hidden=3):
    counts = np.array([50, 30, 20, 10, 9, 8, 7, 3, 2, 1])
    m = lm.GatedModel(counts, np.array([5.0, 0.0, 2.0]), hidden=hidden, classes=4, seed=3)
    rng = np.random.default_rng(0)
    for k, v in m.p.items():
        m.p[k] = v.astype(np.float64) + rng.normal(size=v.shape) * 0.3
    return m


def test_probabilities_sum_to_one():
    m = small()
    h = np.random.default_rng(1).normal(size=(1, 3))
    ids = np.arange(13)
    assert np.exp(m.log_probs(np.repeat(h, 13, axis=0), ids)).sum() == pytest.approx(1.0)


def test_gradients():
    m = small()
    part = np.array([[1, 5], [0, 11], [7, 0], [12, 3]])
    last, h = np.array([0, 4]), np.random.default_rng(2).normal(size=(2, 3))

    def loss():
        total, x, prev = 0.0, h, last
        for ids in part:
            x = np.where((prev == 0)[:, None], 0, x)
            x = m.step(prev, x)[0]
            total -= m.log_probs(x, ids).sum()
            prev = ids
        return total / part.size

    grads = m.window(part, last, h, 0)[0]
    rng = np.random.default_rng(5)
    for name, v in m.p.items():
        for _ in range(12):
            i = tuple(rng.integers(0, s) for s in v.shape)
            keep, eps = v[i], 1e-5
            v[i] = keep + eps
            up = loss()
            v[i] = keep - eps
            down = loss()
            v[i] = keep
            assert grads[name][i] == pytest.approx((up - down) / 2 / eps, abs=1e-6), (name, i)


def test_scores_carry_the_state_over_windows(monkeypatch):
    m = small()
    rng = np.random.default_rng(3)
    lens = np.array([1, 45, 7, 21, 20])
    ids = rng.integers(0, 13, lens.sum())
    got = m.score(ids, lens, 0)
    at = 0
    for n, g in zip(lens, got, strict=True):
        h, last, total = np.zeros((1, 3)), np.array([0]), 0.0
        for k in ids[at : at + n]:
            h = m.step(last, h)[0]
            last = np.array([k])
            total += m.log_probs(h, last)[0]
        at += n
        assert g == pytest.approx(total, abs=1e-4)
    monkeypatch.setattr(lm, "WINDOW", 3)
    assert np.allclose(m.score(ids, lens, 0), got, atol=1e-4)


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), None]


def base(rows):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t in rows), key=str)


def got(df):
    rows = df.collect()
    assert all(np.isfinite(r.score) and r.score <= 1e-9 for r in rows)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str), rows


def test_odd_rows(spark, monkeypatch):
    rows = [(i, f"the Cat {'sat ' * (i % 7)} ON mat {i} É\xa0x") for i in range(60)] + [(None, None), (99, ""), (3, "the Cat sat sat sat  ON mat 3 É\xa0x"), (70, " \t\n"), (71, "long " * 30000), (99, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int")
    want = base(rows)
    for known in (1 << 17, 5):
        monkeypatch.setattr(lm, "KNOWN", known)
        assert got(lm.score(docs))[0] == want
    assert lm.score(docs.limit(0)).count() == 0


def test_known_or_joined_words_score_alike(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    monkeypatch.setattr(lm, "SAMPLE", 20)
    a = {r.doc_id: r.score for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "KNOWN", 2 * lm.VOCABULARY)
    monkeypatch.setattr(lm, "BATCH_TOKENS", 5000)
    b = {r.doc_id: r.score for r in lm.score(docs).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 * abs(a[k]) for k in a)


def test_better_than_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    found, rows = got(lm.score(docs))
    assert found == want
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.8


def test_a_pass_trains_on_every_token():
    m = small()
    m.p = {k: v.astype(np.float32) for k, v in m.p.items()}
    rng = np.random.default_rng(7)
    seen = []
    m.window, plain = lambda part, *a: (seen.extend(part.ravel().tolist()), plain(part, *a))[1], m.window
    for n in (1, 39, 41, 187, 25_003):
        seen.clear()
        ids = rng.integers(0, 13, n)
        assert m.train_pass([ids], 0) == n and sorted(seen) == sorted(ids.tolist())


def test_the_network_learns_from_documents_outside_the_sample(spark, monkeypatch):
    trained = []
    plain = lm.train_everywhere
    monkeypatch.setattr(lm, "train_everywhere", lambda *a: trained.append(plain(*a)))
    monkeypatch.setattr(lm, "SAMPLE", 5)
    rng = np.random.default_rng(8)
    tail = " ".join("ab cd" if k % 2 else "ef gh" for k in range(6000))  # beyond SAMPLE_BYTES: no such pair is in a short document
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh"], 30)) if i % 2 else tail) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm.score(docs).collect()
    assert trained == [got[0].train_tokens]
    long = [r for r in got if r.n_tokens > 1000 and r.held_out]
    assert long and all(r.score > 0.8 * r.base_score for r in long)


def test_the_querys_scores_against_brute_force(spark, sf_small):
    """Word by word with plain sums: the state, the class's share, the word's share in its class or by its count in its shape."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    scorer, counts = lm.fit(docs)
    count = {r.word.encode(): r.c for r in counts.collect()}
    m, p = scorer.model, {k: v.astype(np.float64) for k, v in scorer.model.p.items()}
    place = {w: i for i, w in enumerate(scorer.words)}
    k = m.hidden
    squash = lambda x: 1 / (1 + np.exp(-x))

    def share(logits, i):
        e = np.exp(logits - logits.max())
        return math.log10(e[i] / e.sum())

    def brute(text):
        h, last, total = np.zeros(k), scorer.end, 0.0
        for w in [*("" if x is None else x for x in words(text))]:
            w = w.encode()
            g, a = p["x"][last] + p["b"], h @ p["u"]
            z, r = squash(g[:k] + a[:k]), squash(g[k : 2 * k] + a[k : 2 * k])
            n = np.tanh(g[2 * k :] + r * a[2 * k :])
            h = (1 - z) * n + z * h
            logits = h @ p["wc"] + p["bc"]
            if w in place:
                last = place[w]
                c = m.word_class[last]
                inside = np.flatnonzero(m.word_class == c)
                total += share(logits, c) + share(h @ p["ww"][:, inside] + p["bw"][inside], int(np.searchsorted(inside, last)))
            else:
                last = m.n + lm.shape(w)
                total += share(logits, m.classes + lm.shape(w)) + math.log10(count.get(w, 0) + lm.SMOOTH) - scorer.log_shape[lm.shape(w)]
        return total

    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    for r in docs.limit(60).collect():
        assert got[r.doc_id] == pytest.approx(brute(r.text), rel=1e-3)


def test_texts_looked_up_together_give_what_each_gives_alone():
    import pyarrow as pa

    words = [b"", *(b"w%d" % i for i in range(300))]
    s = lm.Scorer(words, np.arange(301, 0, -1), 45_451, 400)
    s.set_shapes(np.full(12, 5.0), np.full(12, 2.0))
    texts = [None, "", "w1 rare rare W2 ünseen", "x " * 200_000, *(f"w{i} w{i + 1} other{i} other{i}" for i in range(100)), "last-rare"]
    groups = list(lm.together(pa.array(texts)))
    assert [t for g in groups for t in g] == texts and len(groups[0]) == 4 and max(map(len, groups)) == lm.LOOKUP
    got, alone = s.score(texts), [s.score([t]) for t in texts]
    assert [dict(c) for c in got[4]] == [dict(a[4][0]) for a in alone]
    for i in range(4):
        assert np.allclose(got[i], [a[i][0] for a in alone], rtol=1e-6)
    ids = np.arange(len(s.model.p["x"]))
    c = s.model.target_class(ids)
    order, edges = s.model.by_class(c)
    assert c.dtype == np.uint16 and all((order[edges[k] : edges[k + 1]] == np.flatnonzero(c == k)).all() for k in range(s.model.classes))
