"""Log-likelihoods of whole documents under a gated recurrent language model, beside a unigram base.

Tokens are words (A-Z lowered, cut at ASCII white space) and one end per document. The whole training
fold is counted; the counts give the base, the model's vocabulary and the biases that it starts
from. The network is a gated recurrent unit whose output is factored by class: first the token's class,
then the word within its class. The `VOCABULARY` commonest words fall into `CLASSES` classes of equal
mass; all others into classes by length and script, within which a word has its smoothed
share of the class's training count. So every text has a proper probability.

The network is trained in numpy by truncated backpropagation through windows of `WINDOW` tokens, the
state carried on from window to window. The driver gives it a start on at most `SAMPLE` training documents
of at most `SAMPLE_BYTES` bytes (in the order of a hash of their ids). From there every partition makes one pass
over all tokens of all its training documents, of any length, and the partitions' parameters are averaged by
their tokens. So the network, like the counts, learns from the whole fold; scores vary a little with how rows
are dealt to partitions.
Scoring runs over whole texts: batches of documents advance together, window by window, each with its
own state from its first token to its end.

A worker knows the counts of the commonest words, at most `KNOWN`; rarer ones leave as (document, word,
repeats) and meet their counts in a join, which is where what is gathered grows with the corpus.

Null text counts as empty (it has the end only). Null ids count as the empty text for the fold. Repeated
rows give repeated rows. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import content_key, cut, held_out, q

FOLDS, FOLD = 10, 0
SMOOTH = 0.1
VOCABULARY, CLASSES, HIDDEN = 2048, 32, 16
KNOWN = 1 << 17
SAMPLE, SAMPLE_BYTES = 1200, 20_000
WINDOW, STREAMS, EPOCHS, RATE = 20, 64, 2, 0.01
#: The pass over the whole fold: streams at most, steps that come before more streams, first rate, steps after which it has
#: fallen by sqrt(2), tokens held by a worker.
PASS_STREAMS, PASS_STEPS, PASS_RATE, PASS_FALL, PASS_TOKENS = 512, 100, 0.004, 100, 2_000_000
#: Documents that advance together, and rows that go through the output at once: what fits a processor's cache.
TOGETHER, ROWS = 1024, 8192
#: Texts whose words are looked up in one call, and the bytes of them after which no other text joins.
LOOKUP, LOOKUP_BYTES = 32, 1 << 18
#: Parts in which the partitions' parameters meet.
SLICES = 16
#: Distinct words that a counting worker holds, and tokens that a scoring worker holds, at most.
FLUSH, BATCH_TOKENS = 400_000, 3_000_000
#: The end of a document as a word: no word is empty. And the shapes of rarer words.
END = b""
LENGTHS, SCRIPTS = 4, 3


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8").lower().split(), END]


def shape(word: bytes) -> int:
    """Class of a word outside the vocabulary: by characters (4 at a time) and by how many bytes are beyond one a character."""
    n = len(word) if word.isascii() else len(word.decode("utf-8"))
    return min(n // 4, LENGTHS - 1) * SCRIPTS + min(len(word) - n, SCRIPTS - 1)


def shape_column(word):
    n = F.length(word)
    return F.least(F.floor(n / 4), F.lit(LENGTHS - 1)) * SCRIPTS + F.least(F.octet_length(word) - n, F.lit(SCRIPTS - 1))


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all rows; the end has the empty word."""

    def run(batches):
        import pyarrow as pa

        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                held.update(tokens(t.as_py()))
                if len(held) > FLUSH:
                    yield out(held)
                    held.clear()
        if held:
            yield out(held)

    return docs.select(q(text_col).cast("string")).mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.negative(x)
    np.exp(e, out=e)
    e += 1
    return np.reciprocal(e, out=e)


def log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each column of logits the log of one entry's share. Works in place and over the first axis, which numpy reduces many columns at a time."""
    m = x.max(axis=0)
    x -= m
    picked = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    return picked - np.log(x.sum(axis=0))


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


class GatedModel:
    """Words 0..n-1 of the vocabulary by class, and shapes after them; input and target ids share that numbering."""

    def __init__(self, counts: np.ndarray, shape_mass: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.n, self.hidden = len(counts), hidden
        mass = np.cumsum(counts) / max(counts.sum(), 1)
        self.word_class = np.minimum((mass - mass[0]) * classes, classes - 1).astype(np.int64)
        self.word_class = np.unique(self.word_class, return_inverse=True)[1]  # no class is empty
        self.bounds = np.searchsorted(self.word_class, np.arange(self.word_class[-1] + 2))
        self.classes = len(self.bounds) - 1
        # 16 bits: numpy sorts those by radix.
        self.class_of = np.concatenate([self.word_class, self.classes + np.arange(len(shape_mass))]).astype(np.uint16)
        by_class = np.add.reduceat(counts.astype(float), self.bounds[:-1])
        f = np.float32
        self.p = {
            "x": (rng.normal(size=(self.n + len(shape_mass), 3 * hidden)) * 0.1).astype(f),
            "u": (rng.normal(size=(hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "b": np.zeros(3 * hidden, f),
            "wc": np.zeros((hidden, self.classes + len(shape_mass)), f),
            "bc": np.log(np.concatenate([by_class, shape_mass]) + 0.5).astype(f),
            "ww": np.zeros((hidden, self.n), f),
            "bw": np.log(counts + 0.5).astype(f),
        }

    def target_class(self, ids: np.ndarray) -> np.ndarray:
        return self.class_of[ids]

    def by_class(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in order of their class, and where each class of words begins and ends there."""
        return np.argsort(classes, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(classes, minlength=self.classes))])

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple:
        k, p = self.hidden, self.p
        g = p["x"][ids] + p["b"]
        a = h @ p["u"]
        zr = sigmoid(g[:, : 2 * k] + a[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(g[:, 2 * k :] + r * a[:, 2 * k :])
        return n + z * (h - n), z, r, n, a[:, 2 * k :]

    def log_probs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target (for a shape: of the class) given the state before it."""
        return np.concatenate([self._log_probs(h[i : i + ROWS], ids[i : i + ROWS]) for i in range(0, len(ids), ROWS)])

    def _log_probs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        p = self.p
        c = self.target_class(ids)
        out = log_share(p["wc"].T @ h.T + p["bc"][:, None], c)
        order, edges = self.by_class(c)
        for k in range(self.classes):
            rows = order[edges[k] : edges[k + 1]]
            lo, hi = self.bounds[k], self.bounds[k + 1]
            if len(rows) and hi - lo > 1:
                out[rows] += log_share(p["ww"][:, lo:hi].T @ h[rows].T + p["bw"][lo:hi, None], ids[rows] - lo)
        return out

    # -- training -----------------------------------------------------------------------------

    def train(self, stream: np.ndarray, end: int, epochs: int = EPOCHS, rate: float = RATE) -> None:
        """Truncated backpropagation over documents' ids laid end to end; the state is cleared after each end."""
        b = min(STREAMS, max(1, len(stream) // (2 * WINDOW)))
        rows = len(stream) // b
        if not rows:
            return
        grid = stream[: b * rows].reshape(b, rows).T
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        total = epochs * -(-rows // WINDOW)
        at = 0
        for _ in range(epochs):
            h, last = np.zeros((b, self.hidden), np.float32), np.full(b, end)
            for s in range(0, rows, WINDOW):
                part = grid[s : s + WINDOW]
                grads, h, last = self.window(part, last, h, end)
                at += 1
                self._adam(grads, moments, at, rate * (1 - 0.9 * at / total))

    def train_pass(self, streams: Iterable[np.ndarray], end: int) -> int:
        """One pass over every id of the streams, each being documents laid end to end; the number of ids."""
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        at = seen = 0
        for stream in streams:
            b = min(PASS_STREAMS, max(1, len(stream) // (PASS_STEPS * WINDOW)))
            rows, over = divmod(len(stream), b)
            starts = np.arange(b) * rows + np.minimum(np.arange(b), over)
            h, last = np.zeros((b, self.hidden), np.float32), np.full(b, end)
            for s in [*range(0, rows, WINDOW), *([rows] if over else [])]:
                n = b if s < rows else over  # the first streams are one id longer
                part = stream[starts[:n] + np.arange(s, min(s + WINDOW, rows) if s < rows else rows + 1)[:, None]]
                grads, h, last = self.window(part, last[:n], h[:n], end)
                at += 1
                seen += part.size
                self._adam(grads, moments, at, PASS_RATE / np.sqrt(1 + at / PASS_FALL))
        return seen

    def window(self, part: np.ndarray, last: np.ndarray, h: np.ndarray, end: int) -> tuple[dict, np.ndarray, np.ndarray]:
        """(gradients of the mean negative log-probability, state, last ids) of one window; rows of part are time."""
        p, k, n = self.p, self.hidden, part.size
        before = np.concatenate([last[None], part[:-1]])
        start = before == end
        gates = (p["x"][before.ravel()] + p["b"]).reshape(*part.shape, -1)
        h0, z, r, c, a, states = (np.empty((*part.shape, k), gates.dtype) for _ in range(6))
        for t in range(len(part)):
            h0[t] = h
            h0[t][start[t]] = 0
            u = h0[t] @ p["u"]
            zr = sigmoid(gates[t, :, : 2 * k] + u[:, : 2 * k])
            z[t], r[t], a[t] = zr[:, :k], zr[:, k:], u[:, 2 * k :]
            c[t] = np.tanh(gates[t, :, 2 * k :] + r[t] * a[t])
            h = states[t] = c[t] + z[t] * (h0[t] - c[t])
        last = part[-1]
        top, ids = states.reshape(n, k), part.ravel()
        g = {name: np.zeros_like(v) for name, v in p.items()}
        d = softmax(p["wc"].T @ top.T + p["bc"][:, None])
        cls = self.target_class(ids)
        d[cls, np.arange(n)] -= 1
        d /= n
        g["wc"], g["bc"] = top.T @ d.T, d.sum(axis=1)
        dtop = d.T @ p["wc"].T
        order, edges = self.by_class(cls)
        for j in range(self.classes):
            lo, hi = self.bounds[j], self.bounds[j + 1]
            rows = order[edges[j] : edges[j + 1]]
            if hi - lo < 2 or not len(rows):
                continue
            there = top[rows]
            e = softmax(p["ww"][:, lo:hi].T @ there.T + p["bw"][lo:hi, None])
            e[ids[rows] - lo, np.arange(len(rows))] -= 1
            e /= n
            g["ww"][:, lo:hi] = there.T @ e.T
            g["bw"][lo:hi] = e.sum(axis=1)
            dtop[rows] += e.T @ p["ww"][:, lo:hi].T
        dtop = dtop.reshape(len(part), -1, k)
        rest = 1 - z
        by_z = h0 - c
        by_z *= z
        by_z *= rest
        by_n = c * c
        np.subtract(1, by_n, out=by_n)
        by_n *= rest
        by_r = 1 - r
        by_r *= r
        by_r *= a
        inner = np.empty_like(gates)
        carry = np.zeros_like(h)
        for t in range(len(part) - 1, -1, -1):
            dh = dtop[t] + carry
            dn = dh * by_n[t]
            gates[t, :, :k], gates[t, :, k : 2 * k], gates[t, :, 2 * k :] = dh * by_z[t], dn * by_r[t], dn
            inner[t, :, : 2 * k], inner[t, :, 2 * k :] = gates[t, :, : 2 * k], dn * r[t]
            carry = dh * z[t] + inner[t] @ p["u"].T
            carry[start[t]] = 0
        g["u"] = h0.reshape(n, k).T @ inner.reshape(n, -1)
        before, gates = before.ravel(), gates.reshape(n, -1)
        order = np.argsort(before.astype(np.uint16) if len(p["x"]) <= 1 << 16 else before, kind="stable")
        own, starts = np.unique(before[order], return_index=True)
        g["x"][own] = np.add.reduceat(gates[order], starts, axis=0)
        g["b"] += gates.sum(axis=0)
        return g, h, last

    def _adam(self, grads: dict, moments: dict, at: int, rate: float) -> None:
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        first, second = rate / (1 - 0.9**at), 1 / np.sqrt(1 - 0.999**at)
        for name, g in grads.items():  # in place: g is used up
            m, v = moments[name]
            g *= g.dtype.type(scale)
            m *= m.dtype.type(0.9)
            v *= v.dtype.type(0.999)
            m += g.dtype.type(0.1) * g
            g *= g
            g *= g.dtype.type(0.001)
            v += g
            np.sqrt(v, out=g)
            g *= g.dtype.type(second)
            g += g.dtype.type(1e-8)
            np.divide(m, g, out=g)
            g *= g.dtype.type(first)
            self.p[name] -= g

    # -- scoring ------------------------------------------------------------------------------

    def score(self, ids: np.ndarray, lens: np.ndarray, end: int) -> np.ndarray:
        """Natural log-probability of each document: lens[i] ids each, laid end to end."""
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        order = np.argsort(-lens, kind="stable")
        out = np.zeros(len(lens))
        for i in range(0, len(order), TOGETHER):  # of like lengths
            part = order[i : i + TOGETHER]
            out[part] = self._score(ids, starts[part], lens[part], end)
        return out

    def _score(self, ids: np.ndarray, s: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
        out = np.zeros(len(n))
        h, last = np.zeros((len(n), self.hidden), np.float32), np.full(len(n), end)
        longest = int(n[0])
        for begin in range(0, longest, WINDOW):
            states, targets, who = [], [], []
            for t in range(begin, min(begin + WINDOW, longest)):
                alive = np.searchsorted(-n, -t, side="left")
                h = self.step(last[:alive], h[:alive])[0]
                last = ids[s[:alive] + t]
                states.append(h)
                targets.append(last)
                who.append(alive)
            got = self.log_probs(np.concatenate(states), np.concatenate(targets)).astype(np.float64)
            at = 0
            for alive in who:
                out[:alive] += got[at : at + alive]
                at += alive
        return out


class Scorer:
    """What a worker needs: the known words' ids and counts, the totals, and the network."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        words, counts = [words[i] for i in order], counts[order]
        n = min(VOCABULARY, len(words))
        if END not in words[:n]:  # it has a place of its own in any case
            held = dict(zip(words, counts.tolist(), strict=True))
            words = [*(w for w in words if w != END)]
            words.insert(min(n, VOCABULARY - 1), END)
            counts = np.array([held.get(w, 0) for w in words])
            n = min(VOCABULARY, len(words))
        self.index = {w: i for i, w in enumerate(words)}
        self.n, self.end = n, self.index[END]
        self.total, self.distinct = total, distinct
        self.log_count = np.log10(counts + SMOOTH)
        self.seen = counts > 0
        self.id_of = np.concatenate([np.arange(n), n + np.array([shape(w) for w in words[n:]], np.int64)]).astype(np.int64)
        self.words, self.counts = words[:n], counts[:n]
        self.plain = [n + shape(b"x" * k) for k in range(64)]  # ids of rarer ASCII words by length
        self.log_shape = self.model = None

    def set_shapes(self, total: np.ndarray, distinct: np.ndarray) -> None:
        """What the words outside the vocabulary come to in each shape; starts the network."""
        self.log_shape = np.log10(total + SMOOTH * (distinct + 1))
        self.model = GatedModel(self.counts, total)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For each word its place among the known ones (-1: unknown) and its id for the network; and the unknown words in order."""
        known = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        ids = self.id_of[known]
        missing = np.flatnonzero(known < 0)
        rare = [words[i] for i in missing]
        plain = self.plain
        ids[missing] = [plain[len(x)] if x.isascii() and len(x) < len(plain) else self.n + shape(x) for x in rare]
        return known, ids, rare

    def stream(self, texts: list[str]) -> np.ndarray:
        return self.ids([w for t in texts for w in tokens(t)])[1]

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """For each text: n_tokens, n_known, base, score (without the counts of words not known here) and those words' counter."""
        parts, others, lens = [], [], []
        for i in range(0, len(texts), LOOKUP):
            words = [tokens(t) for t in texts[i : i + LOOKUP]]
            lens += map(len, words)
            k, ids, rare = self.ids([*chain.from_iterable(words)])
            parts.append((k, ids))
            ends = np.cumsum(k < 0)[np.cumsum([len(w) for w in words]) - 1].tolist()
            others += [Counter(rare[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        lens = np.array(lens)
        known, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        there = known >= 0
        log_count = np.where(there, self.log_count[np.maximum(known, 0)], 0.0)
        base = np.add.reduceat(log_count, starts) - lens * np.log10(self.total + SMOOTH * (self.distinct + 1))
        n_known = np.add.reduceat(np.where(there, self.seen[np.maximum(known, 0)], False).astype(np.int64), starts)
        outside = ids >= self.n
        within = np.where(outside, log_count - self.log_shape[np.where(outside, ids - self.n, 0)], 0.0)
        score = self.model.score(ids, lens, self.end) / np.log(10) + np.add.reduceat(within, starts)
        return lens, n_known, base, score, others


def together(column) -> Iterable[list[str | None]]:
    """The texts of an Arrow column, up to LOOKUP at a time."""
    held, load = [], 0
    for t in column:
        held.append(t.as_py())
        load += len(held[-1] or "")
        if len(held) == LOOKUP or load >= LOOKUP_BYTES:
            yield held
            held, load = [], 0
    if held:
        yield held


def train_everywhere(scorer: Scorer, texts: DataFrame) -> int:
    """Trains the scorer's network on all rows of texts(t), per partition from the same start, and averages; the number of tokens trained on."""
    sc = texts.sparkSession.sparkContext.broadcast(scorer)

    def streams(batches):
        held, load = [], 0
        for b in batches:
            for texts in together(b.column(0)):
                held.append(sc.value.stream(texts))
                load += len(held[-1])
                if load >= PASS_TOKENS:
                    yield np.concatenate(held)
                    held, load = [], 0
        if held:
            yield np.concatenate(held)

    def run(batches):
        import pyarrow as pa

        model = copy.copy(sc.value.model)
        model.p = {k: v.copy() for k, v in model.p.items()}
        if n := model.train_pass(streams(batches), sc.value.end):
            slices = [x.tobytes() for x in np.array_split(np.concatenate([v.ravel() for v in model.p.values()]), SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array(slices, pa.binary())], names=["k", "n", "w"])

    def total(batches):
        import pyarrow as pa

        n, held = {}, {}
        for b in batches:
            for r in b.to_pylist():
                n[r["k"]] = n.get(r["k"], 0) + r["n"]
                held[r["k"]] = held.get(r["k"], 0.0) + np.frombuffer(r["w"], np.float32) * np.float64(r["n"])
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array([*n.values()], pa.int64()), pa.array([(v / n[k]).astype(np.float32).tobytes() for k, v in held.items()], pa.binary())], names=["k", "n", "w"])

    # Slices of the parameters meet, so no task holds a model per partition and the driver gets one model.
    trained = texts.select("t").mapInArrow(run, "k int, n bigint, w binary")
    found = sorted(trained.repartition(SLICES, "k").mapInArrow(total, "k int, n bigint, w binary").collect())
    sc.unpersist()
    if not found:
        return 0
    mean, at = np.concatenate([np.frombuffer(r.w, np.float32) for r in found]), 0
    for k, v in scorer.model.p.items():
        scorer.model.p[k] = mean[at : at + v.size].reshape(v.shape)
        at += v.size
    return found[0].n


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Scorer, DataFrame]:
    """A scorer learnt from the training fold, and the fold's (word, c)."""
    d = docs.select(q(id_col).alias("i"), F.coalesce(q(text_col).cast("string"), F.lit("")).alias("t")).filter(~held_out(F.col("i"), FOLDS, FOLD))
    counts = cut(count_words(d, "t"))
    total = counts.agg(F.sum("c").alias("n"), F.count("c").alias("v")).first()
    # The commonest words by a threshold on the count, so that no task sends words that aren't taken. Eighths of a
    # doubling are fine enough; the list of their sizes has a few hundred rows at any size of corpus.
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = None, 0
    for r in sorted(sizes, key=lambda r: -r.level):
        if held + r.n > KNOWN:
            break
        least, held = r.level, held + r.n
    top = counts.filter(level >= least).collect() if least is not None else []
    scorer = Scorer([r.word.encode("utf-8") for r in top], np.array([r.c for r in top], np.int64), total.n or 0, total.v)
    vocabulary = counts.sparkSession.createDataFrame([(w.decode("utf-8"),) for w in scorer.words], "word string")
    shapes = counts.join(F.broadcast(vocabulary), "word", "left_anti").groupBy(shape_column(F.col("word")).cast("int").alias("s")).agg(F.sum("c").alias("n"), F.count("c").alias("v")).collect()
    mass, kinds = np.zeros(LENGTHS * SCRIPTS), np.zeros(LENGTHS * SCRIPTS)
    for r in shapes:
        mass[r.s], kinds[r.s] = r.n, r.v
    scorer.set_shapes(mass, kinds)
    # The start's sample by a threshold on the hash of the id, so that no task sends texts that aren't taken.
    short = d.filter(F.octet_length("t") <= SAMPLE_BYTES).select(F.xxhash64("i").alias("h"), "t")
    last = short.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if last is not None:
        texts = [r.t for r in short.filter(F.col("h") <= last).orderBy("h", "t").limit(SAMPLE).collect()]
        scorer.model.train(scorer.stream(texts), scorer.end)
    train_everywhere(scorer, d)
    return scorer, counts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    scorer, counts = fit(docs, id_col, text_col)
    sc = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        import pyarrow as pa

        s = sc.value
        for b in batches:
            rows = b.num_rows
            size = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in b.column(2)]) // 4 + 1
            cuts = [0]
            load = 0
            for i in range(rows):
                if load and load + size[i] > BATCH_TOKENS:
                    cuts.append(i)
                    load = 0
                load += size[i]
            for lo, hi in zip(cuts, [*cuts[1:], rows], strict=True):
                if lo == hi:
                    continue
                n, known, base, got, others = s.score(b.column(2)[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(k)[lo:hi] for k in (0, 1)), pa.array([" %d" % i for i in range(lo, hi)], pa.string()), pa.array([1] * (hi - lo), pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(got)], names=names)
                who = np.repeat(np.arange(lo, hi), [len(o) for o in others])
                if len(who):
                    take, gap = pa.array(who), len(who)
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in (0, 1)), pa.array([w for o in others for w in o], pa.string()), pa.array([c for o in others for c in o.values()], pa.int64()), *(pa.nulls(gap, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)

    names = ["row", "key", "word", "times", "n_tokens", "n_known", "base", "score"]
    k1, k2 = content_key(q(id_col), q(text_col).cast("string"))
    d = docs.select(q(id_col).alias("row"), F.struct(k1.alias("k1"), k2.alias("k2")).alias("key"), q(text_col).cast("string").alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    parts = d.mapInArrow(run, f"row {kind}, key struct<k1:bigint,k2:bigint>, word string, times bigint, n_tokens bigint, n_known bigint, base double, score double")
    # A document's own row has a word with a space, which no word has: it meets nothing, and no two rows crowd one key.
    parts = parts.withColumn("word", F.when(F.col("n_tokens").isNotNull(), F.concat("word", F.lit(" "), F.col("key.k1"))).otherwise(F.col("word")))
    met = parts.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    extra = F.when(F.col("n_tokens").isNull(), F.col("times") * F.log10(c + SMOOTH)).otherwise(0.0)
    per = met.groupBy("row", "key").agg(
        F.count("n_tokens").alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.when(F.col("n_tokens").isNotNull(), F.col("n_known")).when(c > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + extra).alias("base"), F.sum(F.coalesce("score", F.lit(0.0)) + extra).alias("score"),
    )
    # Rows alike in id and text have summed up; each gets its share back.
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    share = lambda x: (F.col(x) / F.col("copies"))
    return per.select(
        F.col("row").alias(id_col), held_out(F.col("row"), FOLDS, FOLD).alias("held_out"), F.round(share("n_tokens")).cast("long").alias("n_tokens"), F.round(share("n_known")).cast("long").alias("n_known"),
        F.lit(scorer.total).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("score").alias("score"),
    )
