"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its evidence is a vector of surface features of itself and of the lines
before and after it, and neighbouring labels depend on each other. The chain is fitted by maximum
likelihood (every line of a labelled document bears the document's label) on a bounded sample of
labelled documents, then every line of every document gets its marginal by forward-backward. The
document's quality is the mean marginal weighted by line length, calibrated by a logistic curve that is
fitted on the same sample.

The sample that it is fitted on: at most `SAMPLE` labelled documents in the order of a hash of their ids, of those with at
most `SAMPLE_CHARS` characters (both are parameters). Everything else covers all rows and whole texts. Labels, ids, languages
and sources are no inputs of a score. Null text counts as empty; an empty text is one empty line and is
scored like any other. Documents whose label is null or contradictory aren't learnt from. Without examples of
both labels nothing can be learnt, and every score is the known label's value, or 1 if there is none.
Repeated rows get repeated results; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import fresh, held_out, q

SAMPLE = 4000
SAMPLE_CHARS = 20_000
THRESHOLD = 0.7
FOLDS, FOLD = 4, 2
#: Documents featurised at once, and cells of the padded matrix that runs through the chain at once.
GROUP, CELLS = 256, 1 << 18
#: Rows that a worker scores and returns at once.
SLICE = 1024
#: Byte classes: upper, lower, digit, space, stop, shout, bar, symbol, beyond ASCII.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"()-", b"!?", b"|", b"#$%&*@^~<>{}[]\\/_=+`", bytes(range(128, 256)))
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _of in enumerate(CLASSES):
    _CLASS[list(_of)] = _k


def featurise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes, number of lines of each text) of whole texts."""
    split = [t.split("\n") for t in texts]
    per_doc = np.array([len(x) for x in split])
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8"), np.uint8)
    ends = np.flatnonzero(data == 10)
    size = np.diff(ends, prepend=-1) - 1
    k = len(CLASSES) + 1
    line = np.repeat(np.arange(len(ends)), size + 1)
    counts = np.bincount(line * k + _CLASS[data], minlength=len(ends) * k).reshape(-1, k)[:, : k - 1].astype(np.float64)
    words, fresh, again, overlap, rare = [], [], [], [], []
    for ls in split:
        seen: dict[str, int] = {}
        for x in ls:
            seen[x] = seen.get(x, 0) + 1
        vocabulary: set[str] = set()
        total = 0
        before: set[str] = set()
        for x in ls:
            w = x.split()
            own = set(w)
            words.append(len(w))
            fresh.append(len(own))
            again.append(seen[x] - 1)
            overlap.append(len(own & before) / len(own) if own else 0.0)
            before = own
            vocabulary |= own
            total += len(w)
        rare.append(len(vocabulary) / total if total else 1.0)
    n = np.array(words, float)
    held = np.maximum(size, 1)[:, None]
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 8], 1)
    doc_words = np.add.reduceat(n, np.concatenate([[0], np.cumsum(per_doc)[:-1]]))
    last = data[np.maximum(ends - 1, 0)]
    own = np.column_stack([
        counts / held, counts[:, 0] / letters, counts[:, 7] > 0, counts[:, 5] > 0, counts[:, 6] > 0,
        np.log1p(size) / 5, np.log1p(n) / 4, np.log1p(size / np.maximum(n, 1)) / 3,
        np.where(n > 0, np.array(fresh) / np.maximum(n, 1), 1.0), np.log1p(again), overlap,
        np.isin(last, np.frombuffer(b".!?", np.uint8)) & (size > 0), size == 0,
        np.repeat(np.array(rare), per_doc), np.repeat(np.log1p(doc_words) / 6, per_doc), np.repeat(np.log1p(per_doc) / 4, per_doc),
    ]).astype(np.float64)
    start = np.zeros(len(own), bool)
    start[np.cumsum(per_doc)[:-1]] = start[0] = True
    stop = np.roll(start, -1)
    prev = np.where(start[:, None], 0.0, np.roll(own, 1, axis=0))
    post = np.where(stop[:, None], 0.0, np.roll(own, -1, axis=0))
    return np.column_stack([own, prev, post, start, stop, np.ones(len(own))]), size, per_doc


def chain(unary: np.ndarray, lens: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(forward, backward) log-odds of "good" for each line.

    unary: log-odds of each line by itself; lens: lines of each document; t: 2 x 2 log-potentials [before, after].
    """
    forward, backward = np.empty_like(unary), np.zeros_like(unary)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    order = np.argsort(-lens, kind="stable")
    at = 0
    while at < len(order):
        longest = lens[order[at]]
        part = order[at : at + max(1, CELLS // max(longest, 1))]
        at += len(part)
        s, n = starts[part], lens[part]
        alive = np.searchsorted(-n, -np.arange(longest), side="left")  # documents with more than i lines come first
        r = unary[s]
        forward[s] = r
        for i in range(1, longest):
            k = alive[i]
            r = r[:k]
            x = s[:k] + i
            r = unary[x] + np.logaddexp(r + t[1, 1], t[0, 1]) - np.logaddexp(r + t[1, 0], t[0, 0])
            forward[x] = r
        for i in range(longest - 2, -1, -1):
            x = s[: alive[i + 1]] + i
            v = unary[x + 1] + backward[x + 1]
            backward[x] = np.logaddexp(v + t[1, 1], t[1, 0]) - np.logaddexp(v + t[0, 1], t[0, 0])
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class LineField:
    """A fitted field: scales of the features, weights, transitions and the calibration's slope and offset."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    @staticmethod
    def always(value: float) -> LineField:
        return LineField(*(np.zeros(0) for _ in range(4)), constant=value)

    def raw(self, texts: list[str]) -> np.ndarray:
        """Log-odds of each document's mean marginal, weighted by line length."""
        x, size, lens = featurise(texts)
        u = ((x - self.mean) / self.scale) @ self.weights
        f, b = chain(u, lens, self.transition)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        w = size + 1.0
        p = np.add.reduceat(w * sigmoid(f + b), starts) / np.add.reduceat(w, starts)
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return np.log(p / (1 - p))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = [self.raw([t or "" for t in texts[i : i + GROUP]]) for i in range(0, len(texts), GROUP)]
        return sigmoid(self.slope * np.concatenate(out) + self.offset) if out else np.zeros(0)


def fit(texts: list[str], labels: list[int], rounds: int = 250, rate: float = 0.05, decay: float = 1e-3) -> LineField:
    """Maximum-likelihood fit by full-batch Adam; each document weighs the same."""
    y_doc = np.array(labels, float)
    if len(set(labels)) < 2:
        return LineField.always(float(labels[0]) if labels else 1.0)
    parts = [featurise(texts[i : i + GROUP]) for i in range(0, len(texts), GROUP)]
    x, lens = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale = 0.0, np.where(scale < 1e-9, 1.0, scale)
    x = (x - mean) / scale
    y, weight = np.repeat(y_doc, lens), np.repeat(1 / lens, lens)
    later = np.ones(len(y), bool)
    later[np.concatenate([[0], np.cumsum(lens)[:-1]])] = False
    second = np.flatnonzero(later)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, rounds + 1):
        u = x @ w
        f, b = chain(u, lens, t)
        p = sigmoid(f + b)
        grad = x.T @ (weight * (p - y)) / len(lens) + decay * w
        # pair marginals of each line and the one before it
        a, c = f[second - 1], u[second] + b[second]
        e = np.stack([np.full(len(a), t[0, 0]), t[0, 1] + c, t[1, 0] + a, t[1, 1] + a + c])
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        same = y[second]
        e[0] -= 1 - same
        e[3] -= same
        pair = (e * weight[second]).sum(axis=1) / len(lens) + decay * t.ravel()
        g = np.concatenate([grad, pair])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-4]
        t -= move[-4:].reshape(2, 2)
    field = LineField(mean, scale, w, t)
    z = np.concatenate([field.raw(texts[i : i + GROUP]) for i in range(0, len(texts), GROUP)])
    slope, offset = 0.1, 0.0
    for _ in range(50):  # Newton's method for the calibration, slightly regularised
        p = sigmoid(slope * z + offset)
        d = p * (1 - p) + 1e-6
        g = np.array([(z * (p - y_doc)).sum() + 0.1 * slope, (p - y_doc).sum()])
        h = np.array([[(d * z * z).sum() + 0.1, (d * z).sum()], [(d * z).sum(), d.sum()]])
        change = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = slope - change[0], offset - change[1]
    field.slope, field.offset = float(max(slope, 0.0)), float(offset)
    return field


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField:
    """A field learnt from the labelled documents outside the held-out fold, of which the driver gets at most `sample`."""
    known = labels.select(q(id_col).alias("i"), q(label_col).cast("int").alias("y")).filter("i is not null and y in (0, 1)").filter(~held_out(F.col("i"), FOLDS, FOLD))
    known = known.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("i", "y")
    text = docs.select(q(id_col).alias("i"), F.coalesce(q(text_col).cast("string"), F.lit("")).alias("t")).filter(F.length("t") <= chars)
    chosen = text.select("i").distinct().join(known, "i").orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = text.join(F.broadcast(chosen), "i").orderBy(F.xxhash64("i"), "i", "t").limit(sample).select("t", "y").collect()
    return fit([r.t for r in rows], [r.y for r in rows])


def score(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its score (double) as a last column beside all others, __score unless docs has one of that name."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                got = field.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names) - 1], pa.array(got, pa.float64())], names=names)

    # By position, as mapInArrow doesn't take names with dots. A text that is a string already goes to the worker once.
    names = [f"c{i}" for i in range(len(docs.columns) + 1)]
    plain = text_col in docs.columns and isinstance(docs.schema[text_col].dataType, T.StringType)
    at = docs.columns.index(text_col) if plain else len(docs.columns)
    out = docs.select(*[q(c).alias(n) for c, n in zip(docs.columns, names, strict=False)], *([] if plain else [q(text_col).cast("string").alias(names[-1])]))
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=False)], T.StructField(names[-1], T.DoubleType())])
    return out.mapInArrow(run, schema).toDF(*docs.columns, fresh(docs, "__score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    narrow = docs.select("doc_id", "text")
    field = train(narrow, labels)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("__t")), field, text_col="__t")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= threshold, 1).otherwise(0).alias("predicted"))
