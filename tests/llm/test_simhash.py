import random

import numpy as np
import xxhash

from tidewell.llm import simhash


def brute_print(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    fp = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    name = lambda g: min((x for x in g if x is not None), default=None)
    return sorted(((rows[i][0], f"{fp[i]:016x}", name(groups[find(i)])) for i in range(len(rows))), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_golay_is_perfect():
    g = simhash.Golay()
    assert len(set(g.error.tolist())) == 2048
    rng = np.random.default_rng(1)
    m = rng.integers(0, 4096, 500, dtype=np.uint32)
    word = (m << 11) | g.high[m]
    for n in range(4):
        noisy = word.copy()
        for row in range(len(word)):
            for b in rng.choice(23, n, replace=False):
                noisy[row] ^= np.uint32(1 << int(b))
        index, weight = g.decode(noisy)
        assert (index == m).all() and (weight == n).all()


def test_two_bits_apart_always_share_a_key():
    g, rng = simhash.Golay(), np.random.default_rng(2)
    a = rng.integers(0, 2**64, 20000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64))
    b = b ^ np.where(rng.random(len(a)) < 0.8, np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64), np.uint64(0))
    ka, kb = ({*zip(*map(np.ndarray.tolist, simhash.keys(x.view(np.int64), g)), strict=True)} for x in (a, b))
    assert {r for r, _ in ka & kb} == set(range(len(a)))


def test_small_texts(spark):
    rows = [(5, None), (3, ""), (4, " \n\t "), (1, "a"), (2, "A"), (9, "b c"), (8, "one two three four"), (7, "ONE two\nthree\x0bfour"), (None, "one two three four"), (6, "É b c"), (10, "é b c"), (1, "a"), (11, "w " * 70000), (None, "lonely words here now"), (12, "x\xa0y z")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    assert got(simhash.near_duplicates(docs)) == brute(rows)
    assert got(simhash.near_duplicates(docs.limit(0))) == []


def components(fps, limit, monkeypatch, spark):
    from tidewell.llm.components import connected_components

    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long").distinct()
    edges = simhash.links(df)
    assert edges.filter("bit_count(u ^ v) > 2").count() == 0
    return {r.id: r.component for r in connected_components(edges).collect()}


def test_links_with_and_without_pairs(spark, monkeypatch):
    rng = random.Random(3)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            fps.append(x)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    fps = np.array(sorted(set(fps)), np.uint64)
    signed = fps.view(np.int64)
    close = [[j for j in range(len(fps)) if j != i and (int(fps[i]) ^ int(fps[j])).bit_count() <= 2] for i in range(len(fps))]
    label = {}
    for i in range(len(fps)):
        if i not in label and close[i]:
            todo, seen = [i], {i}
            while todo:
                for j in close[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            for j in seen:
                label[j] = min(int(signed[k]) for k in seen)
    want = {int(signed[i]): c for i, c in label.items()}
    assert components(signed, 48, monkeypatch, spark) == want
    assert components(signed, 1, monkeypatch, spark) == want


def test_corpus(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    assert got(simhash.near_duplicates(docs)) == brute([tuple(r) for r in docs.collect()])
