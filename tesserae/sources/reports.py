"""Metric tables as files, and weights of models as plain arrays (never pickles)."""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame


def write_csv(report: DataFrame, path: str, columns: list[str]) -> None:
    """Those columns in that order, with a header; others are left out. Reports have a row per configuration, hence one file."""
    report.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def save_checkpoint(path: str | Path, *, weights: dict[str, np.ndarray], epoch: int, history: list[dict], config: dict, optimizer: dict[str, np.ndarray] | None = None) -> None:
    """One file of arrays, put in place whole: a run that dies while writing leaves the file before."""
    arrays = {f"weights/{k}": v for k, v in weights.items()} | {f"optimizer/{k}": np.asarray(v) for k, v in (optimizer or {}).items()}
    fresh = f"{path}.part"
    with open(fresh, "wb") as f:
        np.savez(f, **arrays, meta=np.array(json.dumps({"epoch": epoch, "history": history, "config": config})))
    os.replace(fresh, path)


def load_checkpoint(path: str | Path) -> tuple[dict[str, np.ndarray], dict]:
    """(weights, {epoch, history, config, optimizer}); arrays only, so nothing in a file is run."""
    with np.load(path, allow_pickle=False) as f:
        own = lambda part: {k.removeprefix(part): f[k] for k in f.files if k.startswith(part)}
        return own("weights/"), json.loads(str(f["meta"])) | {"optimizer": own("optimizer/")}


def save_run(path: str | Path, run, config: dict) -> None:
    """A training run's checkpoint: weights, optimizer, epoch and history."""
    adam = run.adam
    state = {"steps": adam.steps, "rate": adam.rate, "keep": adam.keep, "epsilon": adam.epsilon} | ({} if adam.mean is None else {"mean": adam.mean, "square": adam.square})
    save_checkpoint(path, weights=run.weights, epoch=run.epoch, history=run.history, config=config, optimizer=state)


def load_run(path: str | Path, **sizes):
    """(run, config) of a checkpoint. ValueError where its weights don't have the shapes of a model of the given, else the stored, sizes."""
    from ..operators import model
    from ..operators.training import Adam, Run

    weights, meta = load_checkpoint(path)
    wanted = {k: v.shape for k, v in model.random_weights(0, **(meta["config"].get("sizes", {}) | sizes)).items()}
    if {k: v.shape for k, v in weights.items()} != wanted:
        odd = sorted(k for k in wanted.keys() | weights.keys() if wanted.get(k) != getattr(weights.get(k), "shape", None))
        raise ValueError(f"{path}: {', '.join(odd)} don't fit the model")
    o = meta["optimizer"]
    adam = Adam(float(o["rate"]), tuple(o["keep"].tolist()), float(o["epsilon"]), int(o["steps"]), o.get("mean"), o.get("square")) if o else Adam()
    return Run(weights, adam, meta["epoch"], meta["history"]), meta["config"]


def next_epoch(checkpoint: dict) -> int:
    return checkpoint["epoch"] + 1
