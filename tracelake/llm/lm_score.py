"""Language-model scores of whole texts: unigram counts, and a log-bilinear model trained by noise-contrastive estimation.

Tokens are words and one end for each text. Counts cover every training text. The neural model predicts a token from the two
before it, in steps: its class, where the most frequent words and the end have classes of their own and all other words
share one; for those, the group and the cell of their class. Half of the cells hold one word each, the next most frequent
ones; the other half deal all further words by their hash, and within such a cell the unigram counts decide. Cells grow with the
root of the vocabulary, and each has vectors of its own as context and as target. Each partition of the training texts makes
one pass of updates in numpy, and the parameters are averaged, each row by how often it was met. Scoring multiplies contexts
with all classes, all groups, and the cells of the token's group in batches, so that the probabilities of all words sum to one exactly.

Words travel as 64-bit hashes. The most frequent counts (a fixed number) are broadcast; the rest is joined. A null or empty
text is its end alone; without any training text all counts are 0. A null id is never trained on. Repeated rows get equal results.
Very long texts are hashed and scored in blocks. Documents are told apart by id and text hash; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common
from tracelake.llm.common import stored

END = np.uint64(0x5851F42D4C957F2D)
#: Distinct tokens that a task gathers before it hands its counts on.
GATHERED = 1 << 21


@dataclass(frozen=True)
class Neural:
    classes: int = 256
    width: int = 16
    noise: int = 32
    rate: float = 0.1
    batch: int = 1024
    head: int = 1 << 18


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each row's words, and where each row's begin."""
    words, at, _ = common.hash_words(data, offsets)
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [], []

        def flush() -> pa.RecordBatch:
            every, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, np.concatenate(sums)).astype(np.int64)
            keys.clear()
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(total)], ["token", "n"])

        for batch in batches:
            data, offsets = common.text_bytes(batch.column(0))
            for a, b in common.row_blocks(offsets):
                k, s = np.unique(tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0], return_counts=True)
                keys.append(k)
                sums.append(s)
                if sum(map(len, keys)) > GATHERED:
                    yield flush()
        if keys:
            yield flush()

    each = docs.select(F.col("text").cast("binary")).mapInArrow(run, "token long, n long")
    return each.groupBy("token").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes of the most frequent tokens with counts; hashes that have a class; hashes that have a cell of their own;
    what the words of each cell weigh; totals of all training tokens."""

    keys: np.ndarray
    n: np.ndarray
    classed: np.ndarray
    celled: np.ndarray
    mass: np.ndarray
    total: int
    distinct: int
    tail_mass: float

    @property
    def groups(self) -> int:
        return 1 << ((len(self.mass).bit_length() - 1) // 2)


def cells_for(distinct: int) -> int:
    """Number of cells, a power of two, by the number of distinct tokens."""
    return 1 << max(4, int(np.ceil(np.log2(16 * np.sqrt(max(1, distinct))))))


def vocabulary(counted: DataFrame, how: Neural) -> Vocabulary:
    sums = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # the steps of a scale of counts have a fixed number; as many of the highest are fetched as hold at most how.head tokens
    step = F.floor(F.log2("n") * 16)
    least, room = None, how.head
    for row in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True):
        room -= row.k
        if room < 0:
            break
        least = row.step
    head = counted.where(step >= F.lit(least) if least is not None else F.lit(False)).toPandas()
    head = head.sort_values(["n", "token"], ascending=[False, True])
    keys, n = head["token"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64)
    own = [END, *[k for k in keys[: how.classes] if k != END]][: how.classes - 2]
    classed = np.array(own, np.uint64)
    total, distinct = int(sums.n or 0), int(sums.v)
    half = cells_for(distinct) // 2
    celled = keys[~np.isin(keys, classed)][:half]
    mass = np.zeros(2 * half)
    alone = np.isin(keys, classed) | np.isin(keys, celled)
    mass[: len(celled)] = n[np.isin(keys, celled)] + 0.5
    # all words by hash, less those that have a class or a cell; half a count is for words never seen
    dealt = F.pmod(F.shiftrightunsigned("token", 20), F.lit(half)).alias("cell")
    every = counted.groupBy(dealt).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    at = every["cell"].to_numpy(np.int64)
    own = dealt_to(keys[alone], half)
    seen = np.zeros(half)
    seen[at] = every["n"].to_numpy(np.int64) + 0.5 * every["v"].to_numpy(np.int64)
    mass[half:] = seen - np.bincount(own, n[alone] + 0.5, half) + 0.5 / half
    order = np.argsort(keys)
    return Vocabulary(keys[order], n[order], classed, celled, mass, total, distinct, float(mass.sum()))


def dealt_to(hashes: np.ndarray, half: int) -> np.ndarray:
    """The cell, of ``half``, that words without a cell of their own are dealt to."""
    return ((hashes >> np.uint64(20)) % np.uint64(half)).astype(np.int64)


def _place(among: np.ndarray, distinct: np.ndarray, other: np.ndarray | int) -> np.ndarray:
    """Where each hash stands in a list, or ``other`` if it does not."""
    if not len(among):
        return np.broadcast_to(other, len(distinct)).astype(np.int64)
    order = np.argsort(among)
    at = np.minimum(np.searchsorted(among[order], distinct), len(order) - 1)
    return np.where(among[order][at] == distinct, order[at], other).astype(np.int64)


def classes_of(distinct: np.ndarray, vocab: Vocabulary, size: int) -> np.ndarray:
    """Class of each distinct token: its place among the classed ones, or size - 2 for all others; size - 1 is the start."""
    return _place(vocab.classed, distinct, size - 2)


def cells_of(distinct: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Cell of each distinct token: its own one, or that it is dealt to by its hash."""
    half = len(vocab.mass) // 2
    return _place(vocab.celled, distinct, half + dealt_to(distinct, half))


def contexts(classed: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the last token and of that before it; before the start of a row stands class size - 1."""
    one = np.empty_like(classed)
    two = np.empty_like(classed)
    one[1:], two[2:] = classed[:-1], classed[:-2]
    one[starts[:-1]] = two[starts[:-1]] = size - 1
    second = starts[:-1] + 1
    two[second[second < starts[1:]]] = size - 1
    return one, two


def fresh(how: Neural, cells: int = 0, groups: int = 0) -> dict[str, np.ndarray]:
    """Parameters before training: vectors of classes, then cells, as context; a matrix for each place; vectors and biases, as
    one row each, of classes, groups and cells as target."""
    seed = np.random.default_rng(5)
    small = lambda *shape: seed.normal(0, 0.1, shape).astype(np.float32)

    def target(k: int) -> np.ndarray:
        return np.hstack([small(k, how.width), np.zeros((k, 1), np.float32)])

    eye = np.eye(how.width, dtype=np.float32)
    start = {"r": small(how.classes, how.width), "t": target(how.classes), "c1": eye + small(how.width, how.width) / 10, "c2": eye / 2 + small(how.width, how.width) / 10}
    return {**start, "r": np.vstack([start["r"], small(cells, how.width)]), "group": target(groups), "cell": target(cells)}


def log_share(weight: np.ndarray) -> np.ndarray:
    """Logarithm of each one's share; what weighs nothing is as good as impossible."""
    return np.where(weight > 0, np.log(np.maximum(weight, 1e-300) / max(weight.sum(), 1e-300)), -1e4).astype(np.float32)


def _row_sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers, the sum of the rows of each, how many there are."""
    order = np.argsort(at, kind="stable")
    among = at[order]
    first = np.concatenate([[0], np.flatnonzero(among[1:] != among[:-1]) + 1])
    return among[first], np.add.reduceat(rows.take(order, 0), first, axis=0), np.diff(first, append=len(at))


def _squash(x: np.ndarray) -> np.ndarray:
    """The logistic function, worked out in the place of x."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class _Learner:
    """Parameters under training with the sums of their squared gradients and, for rows, how often they were met."""

    p: dict[str, np.ndarray]
    how: Neural
    logs: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        self.sums = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.met = {k: np.zeros(len(x)) for k, x in self.p.items()}
        self.seed = np.random.default_rng(9)
        self.apart = {k: x + np.float32(np.log(self.how.noise)) for k, x in self.logs.items()}
        self.heaped = {k: np.cumsum(np.exp(x.astype(float))) for k, x in self.logs.items()}

    def step(self, k: str, at: np.ndarray, grad: np.ndarray) -> None:
        """Adagrad."""
        grown = grad * grad
        grown += self.sums[k].take(at, 0)
        self.sums[k][at] = grown
        grown += np.float32(1e-8)
        grad *= np.float32(-self.how.rate)
        grad /= np.sqrt(grown, out=grown)
        grad += self.p[k].take(at, 0)
        self.p[k][at] = grad

    def contrast(self, k: str, q: np.ndarray, y: np.ndarray, scale: int) -> np.ndarray:
        """Noise-contrastive update of one kind of target; its noise is shared by the tokens. Returns the gradient of the contexts."""
        heaped = self.heaped[k]
        z = np.minimum(np.searchsorted(heaped, self.seed.random(self.how.noise) * heaped[-1], "right"), len(heaped) - 1)
        ty, tz = self.p[k].take(y, 0), self.p[k].take(z, 0)
        g = _squash(np.einsum("ij,ij->i", q, ty[:, :-1]) + (ty[:, -1] - self.apart[k][y])) - 1
        h = _squash(q @ tz[:, :-1].T + (tz[:, -1] - self.apart[k][z]))
        rows = np.empty((len(y) + len(z), q.shape[1] + 1), np.float32)
        np.multiply(g[:, None], q, out=rows[: len(y), :-1])
        rows[: len(y), -1] = g
        rows[len(y) :, :-1], rows[len(y) :, -1] = h.T @ q, h.sum(0)
        at, grad, times = _row_sums(np.concatenate([y, z]), rows)
        self.met[k][at] += times
        self.step(k, at, grad / np.float32(scale))
        return g[:, None] * ty[:, :-1] + h @ tz[:, :-1]

    def learn(self, target: np.ndarray, cell: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Updates on a block of tokens, in mini-batches."""
        p, how, wide = self.p, self.how, np.arange(self.how.width)
        kind = np.uint16 if len(p["r"]) <= 1 << 16 else np.int32  # short numbers are sorted faster
        target, cell, one, two = (x.astype(kind) for x in (target, cell, one, two))
        size = len(p["cell"]) // max(1, len(p["group"]))
        for a in range(0, len(target), how.batch):
            y, c, u, v = (x[a : a + how.batch] for x in (target, cell, one, two))
            ru, rv = p["r"].take(u, 0), p["r"].take(v, 0)
            q = ru @ p["c1"] + rv @ p["c2"]
            rest = np.flatnonzero(y == how.classes - 2)
            dq = self.contrast("t", q, y, len(y))
            if len(rest):
                own, c = q.take(rest, 0), c[rest]
                dq[rest] += self.contrast("group", own, c // size, len(y)) + self.contrast("cell", own, c, len(y))
            du, dv = dq @ p["c1"].T, dq @ p["c2"].T
            self.step("c1", wide, ru.T @ dq / np.float32(len(y)))
            self.step("c2", wide, rv.T @ dq / np.float32(len(y)))
            at, grad, times = _row_sums(np.concatenate([u, v]), np.vstack([du, dv]))
            self.met["r"][at] += times
            self.step("r", at, grad / np.float32(len(y)))
        for k in ("c1", "c2"):
            self.met[k] += len(target)


def numbered(flat: np.ndarray, starts: np.ndarray, vocab: Vocabulary, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, where each token is among them; its class, cell, and the two tokens before it by class or by cell."""
    distinct, back = np.unique(flat, return_inverse=True)
    classes, cells = classes_of(distinct, vocab, size), cells_of(distinct, vocab)
    said = np.where(classes == size - 2, size + cells, classes)[back]
    return distinct, back, classes[back], cells[back], *contexts(said, starts, size)


def train(docs: DataFrame, vocab: Vocabulary, how: Neural) -> dict[str, np.ndarray]:
    """Parameters averaged over the partitions: one pass over every training text.

    A partition hands on the rows of its parameters that it has met, each weighted by how often; Spark sums them before the driver
    sees one array for all. Rows nobody has met stay as they were.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    # frequencies in the whole corpus are the noise, and the first biases
    seen = np.ones(how.classes)
    at = _place(vocab.keys, vocab.classed, -1)
    seen[: len(vocab.classed)] += np.where(at >= 0, vocab.n[at], 0) if len(vocab.n) else 0
    seen[how.classes - 2] += vocab.tail_mass
    logs = {"t": log_share(seen), "group": log_share(vocab.mass.reshape(vocab.groups, -1).sum(1)), "cell": log_share(vocab.mass)}
    cells, groups = len(vocab.mass), vocab.groups

    def start() -> dict[str, np.ndarray]:
        p = fresh(how, cells, groups)
        for k, x in logs.items():
            p[k][:, -1] = x
        return p

    values = [f"v{j}" for j in range(how.width + 1)]
    names = list(fresh(how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        learner = _Learner(start(), how, logs)
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(0))
            for a, b in common.row_blocks(offsets):
                flat, starts = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                learner.learn(*numbered(flat, starts, vocab, how.classes)[2:])
        for k, x in learner.p.items():
            met = np.flatnonzero(learner.met[k])
            for a in range(0, len(met), 8192):
                at = met[a : a + 8192]
                rows = np.zeros((len(at), how.width + 1))
                rows[:, : x.shape[1]] = x[at]
                w = learner.met[k][at]
                cols = [pa.array(np.full(len(at), names.index(k), np.int32)), pa.array(at.astype(np.int32)), pa.array(w)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c) for c in (rows * w[:, None]).T.copy())], ["kind", "at", "w", *values])

    parts = docs.select(F.col("text").cast("binary")).mapInArrow(run, "kind int, at int, w double, " + ", ".join(f"{v} double" for v in values))
    mean = parts.groupBy("kind", "at").agg(*[(F.sum(v) / F.sum("w")).cast("float").alias(v) for v in values]).toPandas()
    out = start()
    kinds, at, rows = mean["kind"].to_numpy(), mean["at"].to_numpy(), mean[values].to_numpy(np.float32)
    for i, k in enumerate(names):
        own = kinds == i
        out[k][at[own]] = rows[own][:, : out[k].shape[1]]
    return out


def _log_shares(q: np.ndarray, target: np.ndarray, y: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of the share of target ``y`` in context ``q[back]``; the last column of ``q`` is one, for the biases."""
    s = q @ target.T
    own = s[np.arange(len(y)) if back is None else back, y]
    one = np.ones(len(target), np.float32)
    with np.errstate(over="ignore"):
        total = np.exp(s, out=s) @ one
    norm = np.log(np.maximum(total, 1e-37))
    if len(s) and not 1e-30 < total.min() <= total.max() < 1e30:  # out of the range of short floats
        s = q @ target.T
        top = s.max(1)
        norm = np.log(np.exp(s - top[:, None]) @ one) + top
    return own - (norm if back is None else norm[back])


def log10_classes(p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, target: np.ndarray, size: int, cell: np.ndarray | None = None) -> np.ndarray:
    """log10 of the normalised probability of each target class, and with it of the ``cell`` of those that are of no class of
    their own. Every distinct context is multiplied with the classes once; with the cells of a group all tokens that fall into it."""
    rows = len(p["r"])
    keys, back = np.unique(one * rows + two, return_inverse=True)
    every = np.ones((len(keys), p["r"].shape[1] + 1), np.float32)
    out, step = np.empty(len(target)), 1024
    order = np.argsort(back, kind="stable")
    ends = np.searchsorted(back[order], np.arange(0, len(keys) + step, step))
    for k, a in enumerate(range(0, len(keys), step)):
        part = keys[a : a + step]
        every[a : a + step, :-1] = p["r"][part // rows] @ p["c1"] + p["r"][part % rows] @ p["c2"]
        own = order[ends[k] : ends[k + 1]]
        # the start of a text is no token: it has no share
        out[own] = _log_shares(every[a : a + step], p["t"][:-1], target[own], back[own] - a)
    if cell is not None:
        rest = np.flatnonzero(target == size - 2)
        width = len(p["cell"]) // len(p["group"])
        rest = rest[np.argsort(cell[rest] // width, kind="stable")]
        group = cell[rest] // width
        ends = np.searchsorted(group, np.arange(len(p["group"]) + 1))
        for a, end in zip(ends[:-1], ends[1:]):
            for a in range(a, end, step):
                own = rest[a : min(a + step, end)]
                q, g = every.take(back[own], 0), int(group[a])
                out[own] += _log_shares(q, p["group"], np.full(len(own), g)) + _log_shares(q, p["cell"][g * width : (g + 1) * width], cell[own] - g * width)
    return out / np.log(10)


def score(docs: DataFrame, counted: DataFrame, vocab: Vocabulary, p: dict[str, np.ndarray], how: Neural) -> DataFrame:
    """(doc_id, twin, n_tokens, n_known, base_score, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab, p))
    z = np.log10(vocab.total + 0.5 * (vocab.distinct + 1))
    rows = docs.select("doc_id", F.xxhash64("text").alias("twin"), F.col("text").cast("binary").alias("text"))
    schema = rows.select("doc_id", "twin", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("neural"), F.array(F.lit(0).cast("long")).alias("rare"), F.array(F.lit(0)).alias("times")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = shared.value
        lifted = np.log10(vocab.n + 0.5)
        weight = np.log10(np.maximum(vocab.mass, 1e-300))
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(2))
            for a, b in common.row_blocks(offsets):
                flat, starts = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                distinct, back, classed, cell, one, two = numbered(flat, starts, vocab, how.classes)
                at = np.minimum(np.searchsorted(vocab.keys, distinct), max(0, len(vocab.keys) - 1))
                known = vocab.keys[at] == distinct if len(vocab.keys) else np.zeros(len(distinct), bool)
                logs = np.where(known, lifted[at], 0.0) if len(vocab.keys) else np.zeros(len(distinct))
                neural = log10_classes(p, one, two, classed, how.classes, cell)
                # words dealt to a cell together have each its share of the cell
                neural += np.where((classed == how.classes - 2) & (cell >= len(weight) // 2), logs[back] - weight[cell], 0.0)
                row = common.row_of(starts)
                sums = lambda x: np.bincount(row, x, b - a)  # noqa: E731, B023
                gone = np.flatnonzero(~known[back])
                pairs, times = np.unique(np.stack([row[gone], back[gone]]), axis=1, return_counts=True) if len(gone) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                cut = pa.array(np.searchsorted(pairs[0], np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(a, b - a) for c in batch.columns[:2]),
                        pa.array(np.diff(starts).astype(np.int64)),
                        pa.array(sums(known[back].astype(float)).astype(np.int64)),
                        pa.array(sums(logs[back])),
                        pa.array(sums(neural)),
                        pa.ListArray.from_arrays(cut, pa.array(distinct[pairs[1]].view(np.int64), pa.int64())),
                        pa.ListArray.from_arrays(cut, pa.array(times, pa.int32())),
                    ],
                    schema.names,
                )

    first = stored(rows.mapInArrow(run, schema), "scores")
    tail = first.select("doc_id", "twin", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("doc_id", "twin", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    tail = tail.join(counted, "token", "left").groupBy("doc_id", "twin").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"),
    )
    # rows that repeat a document have each given its rare tokens
    copies = first.groupBy("doc_id", "twin").agg(F.count("*").alias("copies")).withColumnsRenamed({"doc_id": "d", "twin": "t"})
    tail = tail.join(copies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t"))).select("d", "t", (F.col("known") / F.col("copies")).alias("known"), (F.col("logs") / F.col("copies")).alias("logs"))
    both = first.join(tail, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")), "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(float(z))).alias("base_score"),
        (F.col("neural") + logs).alias("score"),
    )


def judge(docs: DataFrame, use: Column, how: Neural = Neural()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every text, learnt from the rows where ``use`` holds."""
    chosen = docs.where(use)
    counted = stored(counts(chosen), "counts")
    vocab = vocabulary(counted, how)
    scored = score(docs, counted, vocab, train(chosen, vocab, how), how)
    return scored.withColumn("train_tokens", F.lit(vocab.total).cast("long"))
