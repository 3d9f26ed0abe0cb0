"""A two-layer graph convolutional network: features are ARRAY<DOUBLE> by vertex, weights small driver arrays.

Dense products run as Arrow batches through numpy with the (fixed, small) weights in the task's code;
sums over edges are one grouped aggregate with a column for each feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexigraph.operators.transforms import degrees
from plexigraph.session import discard, materialize


def coefficients(edges: DataFrame) -> DataFrame:
    """(src, dst, coef): 1 / sqrt(out-degree of src * in-degree of dst)."""
    d = degrees(edges)
    u, v = d.select(F.col("id").alias("src"), "out_degree"), d.select(F.col("id").alias("dst"), "in_degree")
    return edges.select("src", "dst").join(u, "src").join(v, "dst").select("src", "dst", (1 / F.sqrt(F.col("out_degree") * F.col("in_degree"))).alias("coef"))


def graph_sum(coef: DataFrame, x: DataFrame, width: int, backward: bool = False) -> DataFrame:
    """(id, x): sum over edges into each vertex of the source's features times the coefficient (backward: along reversed edges)."""
    src, dst = ("dst", "src") if backward else ("src", "dst")
    sent = coef.join(x, coef[src] == x["id"]).select(F.col(dst).alias("to"), "coef", "x")
    sums = sent.groupBy("to").agg(*[F.sum(F.col("coef") * F.col("x")[j]).alias(f"x{j}") for j in range(width)])
    return sums.select(F.col("to").alias("id"), F.array(*[f"x{j}" for j in range(width)]).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def matmul(x: DataFrame, w: np.ndarray) -> DataFrame:
    """(id, x): each row times w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = _matrix(b.column(1)) @ w
                offsets = pa.array(np.arange(0, out.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["id", "x"])

    return x.select("id", F.col("x").cast("array<double>")).mapInArrow(run, "id long, x array<double>")


def matmul_weight_grad(x: DataFrame, grad: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """x transposed times grad, summed over vertices by partition and then in the JVM; shape[0] * shape[1] numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += _matrix(b.column(0)).T @ _matrix(b.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "g"])

    both = x.select("id", F.col("x").cast("array<double>").alias("a")).join(grad.select("id", F.col("x").alias("b")), "id").select("a", "b")
    out = np.zeros(shape[0] * shape[1])
    for r in both.mapInArrow(run, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).collect():
        out[r["k"]] = r["g"]
    return out.reshape(shape)


def sparse_matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, x) of two matrices in long form (i, j, x)."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("x").alias("ax")), b.select(F.col("i").alias("k"), "j", F.col("x").alias("bx"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("ax") * F.col("bx")).alias("x"))


def sparse_matmul_grad(a: DataFrame, grad: DataFrame) -> DataFrame:
    """(i, j, x): the gradient of the product's second matrix, a transposed times ``grad``; all in long form."""
    return sparse_matmul(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "x"), grad)


def relu(x: DataFrame) -> DataFrame:
    return x.select("id", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))).alias("x"))


def relu_grad(grad: DataFrame, before: DataFrame) -> DataFrame:
    """The gradient where the input was above zero."""
    b = before.select("id", F.col("x").alias("b"))
    return grad.join(b, "id").select("id", F.zip_with("x", "b", lambda g, v: F.when(v > 0, g).otherwise(0.0)).alias("x"))


def dropout(x: DataFrame, p: float = 0.0, seed: int = 1234) -> DataFrame:
    """Keeps a value with probability 1 - p and scales it up; the draw is a hash of (seed, id, place), so reruns agree."""
    if p <= 0:
        return x
    draw = lambda j: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), j), F.lit(1 << 20)) / float(1 << 20)
    return x.select("id", F.transform("x", lambda v, j: F.when(draw(j) >= p, v / (1 - p)).otherwise(0.0)).alias("x"))


def dropout_grad(grad: DataFrame, p: float = 0.0, seed: int = 1234) -> DataFrame:
    """The gradient through :func:`dropout` of the same seed: what was kept is kept and scaled alike, whatever its value."""
    return dropout(grad, p, seed)


def truth(labels: DataFrame, split: int) -> DataFrame:
    """(id, truth): the label where the split matches, else -1."""
    return labels.select("id", F.when(F.col("split") == split, F.col("label")).otherwise(-1).alias("truth"))


def _exp_sum(x: Column) -> Column:
    top = F.array_max(x)
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))


def cross_entropy(logits: DataFrame, true: DataFrame) -> DataFrame:
    """(id, loss) of the vertices with a truth: shifted log-softmax at the truth."""
    rows = logits.join(true.where("truth >= 0"), "id")
    return rows.select("id", (F.log(_exp_sum(F.col("x"))) - (F.element_at("x", F.col("truth") + 1) - F.array_max("x"))).alias("loss"))


def cross_entropy_grad(logits: DataFrame, true: DataFrame) -> DataFrame:
    """Softmax less the one-hot truth, not averaged; zero without a truth."""
    rows = logits.join(true, "id").withColumn("s", _exp_sum(F.col("x"))).withColumn("top", F.array_max("x"))
    g = F.transform("x", lambda v, j: F.when(F.col("truth") >= 0, F.exp(v - F.col("top")) / F.col("s") - F.when(j == F.col("truth"), 1.0).otherwise(0.0)).otherwise(0.0))
    return rows.select("id", g.alias("x"))


def evaluate(logits: DataFrame, true: DataFrame) -> DataFrame:
    """One row: loss and accuracy.  Right means that no logit is above the truth's."""
    rows = logits.join(true.where("truth >= 0"), "id")
    at = F.element_at("x", F.col("truth") + 1)
    loss = F.log(_exp_sum(F.col("x"))) - (at - F.array_max("x"))
    return rows.agg(F.avg(loss).alias("loss"), F.avg((F.array_max("x") <= at).cast("double")).alias("accuracy"))


def quantize(x: DataFrame) -> DataFrame:
    """(id, low, high, q): 8 bits a value between the row's least and greatest; a constant row is all 0."""
    low, high = F.array_min("x"), F.array_max("x")
    q = F.transform("x", lambda v: F.when(high > low, F.floor((v - low) / (high - low) * 255 + 0.5)).otherwise(F.lit(0)).cast("int"))
    return x.select("id", low.alias("low"), high.alias("high"), q.alias("q"))


def dequantize(q: DataFrame) -> DataFrame:
    return q.select("id", F.transform("q", lambda v: F.col("low") + (F.col("high") - F.col("low")) * v / 255).alias("x"))


def cached_sync(values: DataFrame, cache: DataFrame, error: float, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, x, sent): the cached row, moved to the new values only where the largest change is above ``error`` times the largest value."""
    on = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys]
    rows = values.join(cache.select(*[F.col(k).alias(f"c_{k}") for k in keys], F.col("x").alias("c")), on, "left")
    old = F.coalesce("c", F.transform("x", lambda v: F.lit(0.0)))
    diff = F.array_max(F.zip_with("x", old, lambda a, b: F.abs(a - b)))
    sent = diff > F.array_max(F.transform("x", lambda v: F.abs(v))) * error
    return rows.select(*keys, F.when(sent, F.col("x")).otherwise(old).alias("x"), sent.alias("sent"))


def delay_rate(synced: DataFrame) -> DataFrame:
    """One row: the share of rows that were sent."""
    return synced.agg(F.avg(F.col("sent").cast("double")).alias("sent_rate"))


def delay_rates(rounds: DataFrame, window: int = 10) -> DataFrame:
    """``rounds``: (epoch, layer, direction, rows, sent) of each sync.  (window, layer, direction, rate) every ``window`` epochs.

    The rate is what was sent of the rows of a full sync, a round: the first epoch of a window syncs in full, so
    window - 1 rounds count.
    """
    own = rounds.withColumn("window", F.floor((F.col("epoch") - 1) / window).cast("int"))
    return own.groupBy("window", "layer", "direction").agg((F.sum("sent") / F.max("rows") / (window - 1)).alias("rate"))


@dataclass
class SyncSchedule:
    """When replicas sync in full: forward at step 0 and at each 100 steps' fifth, backward at each tenth; a step ends with its backward pass."""

    step: int = 0

    def forward_full(self) -> bool:
        return self.step == 0 or self.step % 100 == 5

    def backward_full(self) -> bool:
        return self.step % 10 == 0

    def advance(self) -> None:
        self.step += 1


@dataclass
class Progress:
    """Moving average of the training accuracy, and the forward error bound, which narrows when accuracy falls below the average."""

    mean_accuracy: float = 0.0
    error: float = 0.1

    def update(self, accuracy: float) -> None:
        if accuracy < self.mean_accuracy - 0.001:
            self.error *= 0.9
        self.mean_accuracy = 0.95 * self.mean_accuracy + 0.05 * accuracy


def glorot(n: int, m: int, seed: int) -> np.ndarray:
    return (np.random.default_rng(seed).random((n, m)) - 0.5) * 2 * np.sqrt(6 / (n + m))


def fixed_weights(n: int, m: int) -> np.ndarray:
    """Weights from a rule, for tests against SQL."""
    i, j = np.meshgrid(np.arange(n), np.arange(m), indexing="ij")
    return (((i * 31 + j * 17) % 101) - 50) / 500.0


@dataclass
class Adam:
    """Bias-corrected Adam; ``decay`` is added to the gradient of the first weight only."""

    lr: float = 0.01
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    decay: float = 5e-4
    step: int = 0
    m: list[np.ndarray] = field(default_factory=list)
    v: list[np.ndarray] = field(default_factory=list)

    def update(self, weights: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        if not self.m:
            self.m, self.v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        self.step += 1
        rate = self.lr * np.sqrt(1 - self.beta2**self.step) / (1 - self.beta1**self.step)
        out = []
        for i, (w, g) in enumerate(zip(weights, grads, strict=True)):
            g = g + self.decay * w if i == 0 else g
            self.m[i] = self.beta1 * self.m[i] + (1 - self.beta1) * g
            self.v[i] = self.beta2 * self.v[i] + (1 - self.beta2) * g * g
            out.append(w - rate * self.m[i] / (np.sqrt(self.v[i]) + self.eps))
        return out


def l2(w: np.ndarray, decay: float = 5e-4) -> float:
    return float(decay * (w * w).sum() / 2)


def l2_table(weights: DataFrame, decay: float = 5e-4) -> DataFrame:
    """One row: the penalty of a weight matrix in long form (w)."""
    return weights.agg((F.lit(decay) * F.sum(F.col("w") * F.col("w")) / 2).alias("penalty"))


def adam_table(weights: DataFrame, step: int, adam: Adam | None = None) -> DataFrame:
    """One step over a matrix in long form: ``weights`` has w, g (gradient), m, v (moments) and any keys; w, m and v are renewed."""
    a = adam or Adam()
    g = F.col("g") + a.decay * F.col("w")
    m, v = a.beta1 * F.col("m") + (1 - a.beta1) * g, a.beta2 * F.col("v") + (1 - a.beta2) * g * g
    rate = a.lr * float(np.sqrt(1 - a.beta2**step)) / (1 - a.beta1**step)
    new = {"w": F.col("w") - rate * m / (F.sqrt(v) + a.eps), "m": m, "v": v}
    return weights.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in weights.columns])


def forward(coef: DataFrame, x: DataFrame, weights: list[np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """(hidden before ReLU, logits)."""
    hidden = graph_sum(coef, matmul(x, weights[0]), weights[0].shape[1])
    return hidden, graph_sum(coef, matmul(relu(hidden), weights[1]), weights[1].shape[1])


@dataclass(frozen=True)
class Epoch:
    """One epoch: loss with L2 and accuracy of the training split, the same of the validation split where it was taken, the moving average."""

    epoch: int
    loss: float
    accuracy: float
    val_loss: float | None
    val_accuracy: float | None
    mean_accuracy: float


class CachedSums:
    """Sums over edges by part, of which a vertex's total is the sum of what each part has sent last.

    ``coef``: (src, dst, coef, part).  A part sends its partial row of a vertex if it has moved by more than the error
    bound allows, or all of them in a full sync.
    """

    def __init__(self, coef: DataFrame) -> None:
        self.coef, self.caches = coef, {}
        self.rounds: list[tuple[int, int, str, int, int]] = []

    def sum(self, x: DataFrame, width: int, layer: int, direction: str, epoch: int, error: float | None) -> DataFrame:
        """(id, x).  ``error``: the bound, or None for a full sync."""
        src, dst = ("dst", "src") if direction == "backward" else ("src", "dst")
        sent = self.coef.join(x, self.coef[src] == x["id"]).select(F.col(dst).alias("to"), "part", "coef", "x")
        cells = [f"x{j}" for j in range(width)]
        parts = sent.groupBy("to", "part").agg(*[F.sum(F.col("coef") * F.col("x")[j]).alias(c) for j, c in enumerate(cells)])
        parts = parts.select(F.col("to").alias("id"), "part", F.array(*cells).alias("x"))
        old = self.caches.get((layer, direction))
        if error is None or old is None:
            now = parts.withColumn("sent", F.lit(True))
        else:
            now = cached_sync(parts, old, error, ("id", "part"))
        now = materialize(now, "cache")
        if old is not None:
            discard(old)
        self.caches[layer, direction] = now
        n = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("sent").cast("long")), F.lit(0))).first()
        self.rounds.append((epoch, layer, direction, n[0], n[1]))
        total = now.groupBy("id").agg(*[F.sum(F.col("x")[j]).alias(c) for j, c in enumerate(cells)])
        return total.select("id", F.array(*cells).alias("x"))


def train(
    coef: DataFrame, x: DataFrame, labels: DataFrame, weights: list[np.ndarray], epochs: int, adam: Adam | None = None, validate: int | None = 2, cached: bool = False,
    log: list[Epoch] | None = None, rounds: list[tuple[int, int, str, int, int]] | None = None,
) -> tuple[list[np.ndarray], list[tuple[int, float, float]]]:
    """Full-graph training.  Returns the weights and (epoch, loss with L2, accuracy) of the training split.

    The split ``validate`` is evaluated with the new weights in the first nine epochs and then in each tenth (None:
    never).  With ``cached``, ``coef`` has a part and replicas sync by :class:`SyncSchedule`: in the forward pass
    within the error bound that :class:`Progress` keeps, in the backward pass whatever moved.  ``log`` gets an
    :class:`Epoch` for each, ``rounds`` (epoch, layer, direction, rows, rows sent) for each sync.
    """
    adam, progress, schedule = adam or Adam(), Progress(), SyncSchedule()
    coef = materialize(coef, "coef")
    sums = CachedSums(coef) if cached else None
    true = truth(labels, 1)
    out = []

    def over_edges(y: DataFrame, width: int, layer: int, epoch: int, backward: bool = False) -> DataFrame:
        if sums is None:
            return graph_sum(coef, y, width, backward)
        full = schedule.backward_full() if backward else schedule.forward_full()
        return sums.sum(y, width, layer, "backward" if backward else "forward", epoch, None if full else 0.0 if backward else progress.error)

    for epoch in range(1, epochs + 1):
        hidden = materialize(over_edges(matmul(x, weights[0]), weights[0].shape[1], 0, epoch), "hidden")
        logits = materialize(over_edges(matmul(relu(hidden), weights[1]), weights[1].shape[1], 1, epoch), "logits")
        row = evaluate(logits, true).first()
        out.append((epoch, row["loss"] + l2(weights[0], adam.decay), row["accuracy"]))
        g2 = materialize(over_edges(cross_entropy_grad(logits, true), weights[1].shape[1], 1, epoch, backward=True), "grad")
        dw2 = matmul_weight_grad(relu(hidden), g2, weights[1].shape)
        g1 = over_edges(relu_grad(matmul(g2, weights[1].T), hidden), weights[0].shape[1], 0, epoch, backward=True)
        dw1 = matmul_weight_grad(x, g1, weights[0].shape)
        weights = adam.update(weights, [dw1, dw2])
        schedule.advance()
        progress.update(row["accuracy"])
        for t in (hidden, logits, g2):
            discard(t)
        val = None
        if validate is not None and (epoch < 10 or epoch % 10 == 0):
            val = evaluate(forward(coef, x, weights)[1], truth(labels, validate)).first()
        if log is not None:
            log.append(Epoch(*out[-1], val and val["loss"] + l2(weights[0], adam.decay), val and val["accuracy"], progress.mean_accuracy))
    if sums is not None and rounds is not None:
        rounds += sums.rounds
    return weights, out
