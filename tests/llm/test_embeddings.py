import math

import numpy as np
import pytest

from tidewell.llm import embeddings


def brute(rows, threshold=0.9):
    unit = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out, comp = [], [None] * n
    for i in range(n):
        if comp[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            for j in seen:
                comp[j] = min((rows[k][0] for k in seen), key=lambda x: (x is None, x))
    for i in range(n):
        out.append((rows[i][0], len(near[i]), comp[i], None if comp[i] is None else rows[i][0] == comp[i]))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(5, [1.0, 0.0, 0.0]), (3, [0.95, 0.1, 0.0]), (4, [1.0, 0.0, 0.0]), (1, None), (2, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [1.0, None, 0.0]), (9, [-1.0, 0.0, 0.0]), (10, [1e30, 0.0, 0.0]), (11, [1e-30, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (12, [1.0, 0.0]), (3, [0.95, 0.1, 0.0]), (13, [float("inf"), 0.0, 0.0]), (14, [2.0]), (15, [3.0]), (16, [-3.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, cid int, key int")
        assert got(embeddings.near_duplicates(df)) == brute(rows)
    assert got(embeddings.near_duplicates(df.limit(0))) == []


def cloud(rng, n, groups, dim=16):
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.1


@pytest.mark.parametrize("block", [1024, 16])
def test_hot_groups_are_cut_into_cells(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    x = cloud(np.random.default_rng(1), 300, 6)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    found, want = got(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), brute(rows)
    assert sum(r[1] for r in found) >= 0.99 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True))  # none below the threshold, none twice


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(500, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = rng.normal(size=v.shape)
    w -= (w * v).sum(axis=1, keepdims=True) * v
    w = 0.9 * v + math.sqrt(0.19) * w / np.linalg.norm(w, axis=1, keepdims=True)
    code = embeddings.product_code(64, 25, 0.9)
    assert np.mean([bool(np.intersect1d(a, b).size) for a, b in zip(code.decode(v), code.decode(w), strict=True)]) >= 0.97
    one = [code.decode(v[i : i + 1])[0] for i in range(50)]
    assert all((a == b).all() for a, b in zip(one, code.decode(v[:50]), strict=True))


def test_corpus_against_brute_force(spark, sf_small):
    from tidewell.llm.registry import QUERIES

    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    want = brute(rows)
    assert got(QUERIES["op1_spherical_caps"](spark, sf_small)) == want
