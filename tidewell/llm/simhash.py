"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments A, B, C of 22, 21 and 21 bits, each padded to a
word of the perfect binary Golay code (23, 12). Two fingerprints that differ in at most two bits
always agree, by the pigeonhole principle, in one segment entirely while the next one in the circle
A, B, C differs in at most one bit. So a key is (segment, its exact bits, codeword index of the
next segment), once for each index that the next segment gives: that of its own codeword and, if
it lies on the rim of its decoding sphere, the lesser ones among those that one bit's change leads
to. Words one bit apart either decode alike or lie on rims that touch, and then both give the lesser
of the two indices. That makes three to eighteen keys, about nine on average.

Keys with up to `PAIR_LIMIT` distinct fingerprints compare their pairs. Larger ones, which a mass of
near copies makes, use an exact way without pairs: each fingerprint names the 65 words within one bit
of it, and two fingerprints are within two bits exactly if they name a word in common, so each links to
the least fingerprint of every such word. Equal fingerprints are one class throughout.

Null text counts as empty; texts without words share fingerprint zero and are linked like others.
Documents meet their class by fingerprint and one of `SALTS` hashes of their id, so that a mass of copies with
one fingerprint is spread over that many keys. Rows with a null id keep their fingerprint and a component, but never give it its name. Repeated rows
give repeated rows; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, q
from tidewell.llm.components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Up to so many fingerprints under a key are compared pair by pair.
PAIR_LIMIT = 48
#: Keys over which the documents of one fingerprint are spread.
SALTS = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Segment widths from the lowest bit, and the code's generator polynomial x^11+x^9+x^7+x^6+x^5+x+1. Fixed values.
SEGMENTS = (22, 21, 21)
GENERATOR = 0b101011100011
LENGTH, CHECK = 23, 11


def fingerprint(text: str | None) -> int:
    """The text's 64-bit SimHash over XXH64 of its word shingles."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = itertools.chain((0,), ends)
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False))
    total, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    while len(part := np.fromiter(itertools.islice(hashes, CHUNK), np.uint64)):
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: the fingerprint as a signed long) for each row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(q(id_col), q(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


class Golay:
    """The code's decoder, from a table of its 2048 syndromes that is built by its own rule."""

    def __init__(self):
        self.high = np.array([self._remainder(m << CHECK) for m in range(1 << (LENGTH - CHECK))], np.uint32)
        self.error = np.zeros(1 << CHECK, np.uint32)
        self.weight = np.zeros(1 << CHECK, np.uint8)
        for n in (1, 2, 3):
            for bits in itertools.combinations(range(LENGTH), n):
                e = sum(1 << b for b in bits)
                s = self._remainder(e)
                self.error[s], self.weight[s] = e, n

    @staticmethod
    def _remainder(v: int) -> int:
        for k in range(LENGTH - 1, CHECK - 1, -1):
            if v >> k & 1:
                v ^= GENERATOR << (k - CHECK)
        return v

    def decode(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword, and the distance to it, of each 23-bit word."""
        s = self.high[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
        return (words ^ self.error[s]) >> CHECK, self.weight[s]

    def indices(self, words: np.ndarray, width: int) -> np.ndarray:
        """(n, 1 + width) codeword indices; repeats where a change of a bit leads to no lesser index."""
        own, weight = self.decode(words)
        near = np.stack([self.decode(words ^ np.uint32(1 << b))[0] for b in range(width)], axis=1)
        near = np.where((near < own[:, None]) & (weight == 3)[:, None], near, own[:, None])
        return np.concatenate([own[:, None], near], axis=1)


def keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every fingerprint."""
    fps = fps.view(np.uint64)
    cuts = np.cumsum((0, *SEGMENTS))
    parts = [((fps >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.uint32) for a, w in zip(cuts, SEGMENTS, strict=False)]
    rows, out = [], []
    for i, part in enumerate(parts):
        j = (i + 1) % len(parts)
        index = np.sort(golay.indices(parts[j], SEGMENTS[j]), axis=1)
        fresh = np.concatenate([np.ones((len(index), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
        r, c = np.nonzero(fresh)
        rows.append(r)
        out.append((np.int64(i) << 40) | (part[r].astype(np.int64) << 12) | index[r, c].astype(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def links(classes: DataFrame) -> DataFrame:
    """(u, v) edges that join all distinct fingerprints `fp` within two bits, directly or through a common neighbour.

    Every edge is itself within two bits.
    """

    def run(batches):
        import pyarrow as pa

        golay = Golay()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, key = keys(fp, golay)
            yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array(key)], names=["fp", "key"])

    keyed = classes.select("fp").mapInArrow(run, "fp bigint, key bigint")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = cut(keyed.join(shared, "key"))
    far = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    lists = keyed.filter(F.col("n") <= PAIR_LIMIT).groupBy("key").agg(F.collect_list("fp").alias("all"))
    close = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: (y < x) & (far(x, y) <= DISTANCE)), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    pairs = lists.select(F.explode(close).alias("e")).select("e.u", "e.v")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    named = keyed.filter(F.col("n") > PAIR_LIMIT).select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    hubs = named.groupBy("word").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = named.join(hubs, "word").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id reachable through links)."""
    prints = cut(fingerprints(docs, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64(q(id_col)), F.lit(SALTS))))
    held = prints.groupBy("fp", "salt").agg(F.min(q(id_col)).alias("least"))
    classes = cut(held.groupBy("fp").agg(F.min("least").alias("least")))
    labels = connected_components(links(classes)).withColumnRenamed("id", "fp")
    named = classes.join(labels, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = cut(named)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = held.select("fp", "salt").join(named.join(ids, "component").select("fp", "component_id"), "fp")
    return prints.join(by_print, ["fp", "salt"], "left").select(q(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
