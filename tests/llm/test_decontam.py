import hashlib
import random
import re

import pytest

from tidewell.llm import decontam


def brute(docs, items, width=10):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    wins = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - width + 1)):
            if w:
                wins.setdefault(tuple(w[s : s + width]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, ids = split(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[k]
        listed = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=str)


ITEM = "One two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, f"start {ITEM.upper()} end"), (2, "one two; three four five six seven eight nine ten"), (3, "two three four five six seven eight nine ten one"),
    (4, None), (5, ""), (6, "short item here. Short item! short ITEM"), (7, "É un éa"), (8, "é un éa"), (None, ITEM), (1, f"start {ITEM.upper()} end"),
    (9, "aa " * 25), (10, " ".join([ITEM] * 40)), (11, "..." * 100), (12, ITEM + " zero " + "a b c"),
]
ITEMS = [(1, ITEM), (2, "short item"), (3, None), (4, ""), (5, "É un éa"), (None, "a b c"), (1, ITEM), (12, "aa aa aa aa aa aa aa aa aa aa aa"), (7, "never seen words")]


def frames(spark, docs, items):
    d = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, n_words int, term string")
    return d, spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, phrase string")


def test_against_brute_force(spark):
    assert rows(decontam.contamination(*frames(spark, DOCS, ITEMS))) == brute(DOCS, ITEMS)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert rows(decontam.contamination(*frames(spark, DOCS, ITEMS))) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    assert rows(decontam.contamination(*frames(spark, [], ITEMS))) == []
    assert rows(decontam.contamination(*frames(spark, DOCS, []))) == brute(DOCS, [])


def test_proximity(spark):
    docs = [(1, "alpha beta x gamma"), (2, "gamma beta alpha"), (3, "alpha a b c d e f g h beta gamma")]
    _, m = decontam.index_and_match(*frames(spark, docs, [(1, "alpha beta gamma")]), width=3, slop=2)
    assert m.filter("not exact").count() == 2 and m.filter("exact").count() == 0


@pytest.mark.parametrize("slop", [1, 3])
def test_near_against_brute_force(spark, slop):
    """Every start is tried for every window; rarer and commoner words, ties of rarity and repeated words included."""
    rng = random.Random(slop)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((3, 40, 300))))) for i in range(30)] + [(30, None), (31, "")]
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(n))) for i, n in enumerate((1, 2, 3, 4, 5, 6, 6, 7))]

    def near(w, phrase):
        return any(all(phrase[j] in w[max(s + j - slop, 0) : max(s + j + slop + 1, 0)] for j in range(len(phrase))) for s in range(-slop, len(w) + slop))

    got = {r.doc_id: r for r in decontam.contamination(*frames(spark, docs, items), width=5, slop=slop).collect()}
    for row, want in zip(sorted(got.values(), key=lambda r: str(r.doc_id)), brute(docs, items, 5), strict=True):
        assert tuple(row)[:6] == want
    for i, t in docs:
        w = (t or "").split()
        assert got[i].n_near == sum(any(near(w, x.split()[s : s + 5]) for s in range(max(1, len(x.split()) - 4))) for _, x in items)


def test_very_long_text_and_ties(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    docs = [(1, long), (2, f"{long} {ITEM}"), (3, "w1 w2"), (4, ITEM)]
    items = [(1, ITEM), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (3, "w9 w8 w7 w6 w5 w4 w3 w2 w1 w0")]
    got = rows(decontam.contamination(*frames(spark, docs, items)))
    times = sum(i % 977 == 5 for i in range(300_000 - 10))
    assert [x[2] for x in got] == [11 * times, 11 * times + 12, 0, 12] and [x[3] for x in got] == [1, 2, 0, 1]


def test_corpus(spark, sf_small):
    d, b = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert rows(decontam.contamination(d, b)) == want
    assert any(r[-1] for r in want)
