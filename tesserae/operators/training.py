"""Training the autoencoder: gradients by tasks, one step of Adam for each batch, a curve of losses, and runs that can be resumed.

A batch is a set of frames that all tasks share: each sums the gradient over its own frames, a few at a time, the sums are added by pieces of
the parameters, and the driver takes the step. What crosses to the driver is as large as the model, whatever the number of frames.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import psnr, unit_hash
from ..sources.scratch import scratch_path
from . import ingest, model

#: Parameters in a piece of the gradient, and values of a group of frames that go through the model at once.
PIECE, GROUP_VALUES = 4096, 1 << 20


def _windows(x: np.ndarray) -> np.ndarray:
    padded = np.pad(x, ((0, 0), (0, 0), (model.PAD, model.PAD), (model.PAD, model.PAD)))
    return np.lib.stride_tricks.sliding_window_view(padded, (model.KERNEL, model.KERNEL), axis=(2, 3))[:, :, :: model.STRIDE, :: model.STRIDE]


def conv_gradients(x: np.ndarray, weight: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sum over conv(x, weight, bias) whose gradient by the result is ``out``: by x, weight and bias."""
    by_x = model.conv_transposed(out, weight, np.zeros(weight.shape[1]))
    return by_x, np.einsum("bdhw,bchwij->dcij", out, _windows(x), optimize=True), out.sum((0, 2, 3))


def transposed_gradients(x: np.ndarray, weight: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of conv_transposed."""
    by_x = model.conv(out, weight, np.zeros(weight.shape[0]))
    return by_x, np.einsum("bchw,bdhwij->cdij", x, _windows(out), optimize=True), out.sum((0, 2, 3))


def squared_error(x: np.ndarray, weights: dict[str, np.ndarray], gradients: bool = True) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(squared error of each frame's reconstruction, gradients of their sum)."""
    inputs, a = [], x
    for name, step in (("down", model.conv), ("up", model.conv_transposed)):
        for i in range(4):
            inputs.append(a)
            a = step(a, weights[f"{name}{i}.weight"], weights[f"{name}{i}.bias"])
            if i < 3:
                a = np.maximum(a, 0)
        if name == "up":
            a = 1 / (1 + np.exp(-a))
    error = a - x
    losses = (error**2).sum((1, 2, 3))
    if not gradients:
        return losses, {}
    grads: dict[str, np.ndarray] = {}
    out = 2 * error * a * (1 - a)
    for name, back in (("up", transposed_gradients), ("down", conv_gradients)):
        for i in reversed(range(4)):
            own = inputs[i + 4 * (name == "up")]
            out, grads[f"{name}{i}.weight"], grads[f"{name}{i}.bias"] = back(own, weights[f"{name}{i}.weight"], out)
            if i > 0:
                out = out * (own > 0)  # own is what the rectifier let through
    return losses, grads


def flat(parts: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parts[k].ravel() for k in sorted(parts)])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


@dataclass
class Adam:
    """The optimizer's state: steps taken, and the running means of gradients and of their squares."""

    rate: float = 1e-3
    keep: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    steps: int = 0
    mean: np.ndarray | None = None
    square: np.ndarray | None = None

    def step(self, values: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        if self.mean is None:
            self.mean, self.square = np.zeros_like(values), np.zeros_like(values)
        a, b = self.keep
        self.steps += 1
        self.mean = a * self.mean + (1 - a) * gradient
        self.square = b * self.square + (1 - b) * gradient**2
        return values - self.rate * (self.mean / (1 - a**self.steps)) / (np.sqrt(self.square / (1 - b**self.steps)) + self.epsilon)


def _frames(part: pd.DataFrame, shape: tuple[int, int, int]) -> Iterator[np.ndarray]:
    """Groups of frames of channels x height x width from 0 to 1, of rows of RGB bytes or of flat planes."""
    c, h, w = shape
    many = max(1, GROUP_VALUES // (c * h * w))
    for at in range(0, len(part), many):
        own = part["x"].iloc[at : at + many]
        if isinstance(own.iloc[0], (bytes, bytearray)):
            x = np.stack([np.frombuffer(v, np.uint8) for v in own]).reshape(-1, h, w, c).transpose(0, 3, 1, 2) / 255.0
        else:
            x = np.stack([np.asarray(v, float) for v in own]).reshape(-1, c, h, w)
        yield x


def _added(pieces: DataFrame, *by: str) -> DataFrame:
    """Pieces with one key added, in the order of their tasks, so that reruns agree."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("task")
        total = np.sum([np.frombuffer(v) for v in part["v"]], axis=0)
        return part.head(1)[["piece", "task"]].assign(v=[total.tobytes()])

    return pieces.groupBy(*by).applyInPandas(add, "piece int, task int, v binary")


def batch_gradient(frames: DataFrame, weights: dict[str, np.ndarray], shape: tuple[int, int, int]) -> tuple[float, np.ndarray]:
    """(mean squared error over all values of the frames, its gradient) of frames (x). ValueError if there are none."""
    spark = frames.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    size = sum(w.size for w in weights.values())

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total, loss, n = np.zeros(size), 0.0, 0
        for part in parts:
            for x in _frames(part, shape) if len(part) else ():
                losses, grads = squared_error(x, shared.value)
                total += flat(grads)
                loss += losses.sum()
                n += x.size
        if n:
            total = np.append(total, [loss, n])
            cuts = [total[at : at + PIECE].tobytes() for at in range(0, len(total), PIECE)]
            yield pd.DataFrame({"piece": range(len(cuts)), "task": TaskContext.get().partitionId(), "v": cuts}).astype({"piece": "int32", "task": "int32"})

    made = frames.select("x").mapInPandas(task, "piece int, task int, v binary")
    if frames.rdd.getNumPartitions() > 64:  # in two steps, so that no place gets a piece from all of many tasks
        made = _added(made.withColumn("part", F.col("task") % 32), "piece", "part")
    rows = _added(made, "piece").collect()
    shared.unpersist()
    if not rows:
        raise ValueError("a batch without frames")
    total = np.concatenate([np.frombuffer(r.v) for r in sorted(rows, key=lambda r: r.piece)])
    return float(total[-2] / total[-1]), total[:-2] / total[-1]


def validate(frames: DataFrame, weights: dict[str, np.ndarray], shape: tuple[int, int, int]) -> dict[str, float]:
    """loss and psnr of frames (batch_id, x): means over batches, each of its mean squared error and of that error's PSNR."""
    shared = frames.sparkSession.sparkContext.broadcast(weights)
    values = int(np.prod(shape))

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                losses = np.concatenate([squared_error(x, shared.value, gradients=False)[0] for x in _frames(part, shape)])
                yield pd.DataFrame({"batch_id": part["batch_id"].to_numpy(), "se": losses})

    each = frames.select("batch_id", "x").mapInPandas(task, "batch_id long, se double").groupBy("batch_id").agg((F.sum("se") / (F.count("*") * values)).alias("mse"))
    row = each.agg(F.avg("mse").alias("loss"), F.avg(psnr(F.col("mse"))).alias("psnr")).first()
    shared.unpersist()
    if row.loss is None:
        raise ValueError("validation without frames")
    return {"loss": row.loss, "psnr": row.psnr}


@dataclass
class Run:
    """What a training run has come to; with it, training goes on as if it had never stopped."""

    weights: dict[str, np.ndarray]
    adam: Adam = field(default_factory=Adam)
    epoch: int = 0
    history: list[dict] = field(default_factory=list)

    @property
    def best(self) -> float:
        return min((r["val_loss"] for r in self.history), default=float("inf"))


def train(
    frames: DataFrame, held: DataFrame, run: Run, *, shape: tuple[int, int, int], epochs: int, batch_size: int, seed: int, id_col: str = "frame_id", x_col: str = "pixels",
    max_batches: int | None = None, augment: Callable[[DataFrame, int], DataFrame] | None = None, saved: Callable[[Run, bool], None] | None = None,
) -> Run:
    """Go on for ``epochs`` epochs over ``frames``; after each, ``held`` is validated and ``saved(run, whether it is the best so far)`` called.

    Frames are (id, RGB bytes or flat planes of values from 0 to 1) of one shape, whose sides are multiples of 16. Each epoch shuffles them by a
    hash of seed, epoch and id, and writes them by batch, so a step reads its own batch only; ids should differ, ties keep no order. The last
    batch may be short. ``augment(frames, epoch)`` may crop or flip. Frames without x are left out.
    """
    if epochs < 1 or batch_size < 1:
        raise ValueError("epochs and batch_size must be 1 or more")
    if shape[1] % model.DOWN or shape[2] % model.DOWN or shape[0] != run.weights["down0.weight"].shape[1]:
        raise ValueError(f"the model doesn't take frames of {shape}")
    spark = frames.sparkSession
    named = lambda df: df.where(F.col(x_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(x_col).alias("x"))
    checked = ingest.batches(named(held), batch_size, order=["id"])
    if max_batches is not None:
        checked = checked.where(F.col("batch_id") < max_batches)
    for epoch in range(run.epoch + 1, run.epoch + epochs + 1):
        began = time.perf_counter()
        own = named(frames if augment is None else augment(frames, epoch))
        path = scratch_path(spark, "epoch")
        ingest.batches(own.withColumn("h", unit_hash(f"{seed}:{epoch}", F.col("id"))), batch_size, order=["h", "id"]).drop("h", "id").write.partitionBy("batch_id").parquet(path)
        ordered = spark.read.schema(f"x {own.schema['x'].dataType.simpleString()}, batch_id long").parquet(path)
        batches = sorted(r.batch_id for r in ordered.select("batch_id").distinct().collect())[:max_batches]  # numbers of directories, no frames
        if not batches:
            raise ValueError("training without frames")
        losses, values = [], flat(run.weights)
        for k in batches:
            loss, gradient = batch_gradient(ordered.where(F.col("batch_id") == k), run.weights, shape)
            values = run.adam.step(values, gradient)
            run.weights = shaped(values, run.weights)
            losses.append(loss)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        found = validate(checked, run.weights, shape)
        better = found["loss"] < run.best
        run.epoch = epoch
        run.history.append({"epoch": epoch, "train_loss": float(np.mean(losses)), "val_loss": found["loss"], "val_psnr": found["psnr"], "elapsed_seconds": time.perf_counter() - began})
        if saved:
            saved(run, better)
    return run
