"""Drawings of latents, symbols, runs and frames, from the tables that the library computes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drawing, entropy, latents
from .files import write_whole


def _put(path: str, made: str | bytes) -> str:
    write_whole(path, made.encode() if isinstance(made, str) else made)
    return path


def latent_plots(rows: DataFrame, folder: str, *, plane: tuple[int, int] = (1, 1), channels: int = 16) -> list[str]:
    """Of (frame_id, channel, pos, x): the histogram with counts as they are and by logarithm, each channel's mean with its deviation, each
    channel's range, and the first channels of the first frame as heatmaps. The paths written."""
    out, folder = [], folder.rstrip("/")
    bins = latents.histogram(rows).orderBy("bin").collect()
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if ends.lo is None:
        raise ValueError("latents without values")
    n = 200
    counts = np.zeros(n)
    for r in bins:
        counts[r["bin"]] = r["n"]
    edges = np.linspace(ends.lo, ends.hi if ends.hi > ends.lo else ends.lo + 1, n + 1).tolist()
    for log in (False, True):
        out.append(_put(f"{folder}/latent_histogram{'_log' if log else ''}.svg", drawing.bars(edges, counts.tolist(), title="Latent values", across="value", log=log)))
    stats = latents.statistics(rows, "channel").orderBy("channel").collect()
    at, mean, std = [r["channel"] for r in stats], np.array([r["mean"] for r in stats]), np.array([r["std"] or 0.0 for r in stats])
    out.append(_put(f"{folder}/channel_mean_std.svg", drawing.lines(at, {"mean": mean.tolist()}, band=((mean - std).tolist(), (mean + std).tolist()), title="Mean and deviation by channel", across="channel")))
    out.append(_put(f"{folder}/channel_range.svg", drawing.lines(at, {"highest": [r["max"] for r in stats], "lowest": [r["min"] for r in stats]}, title="Range by channel", across="channel")))
    first = rows.agg(F.min("frame_id")).first()[0]
    values = rows.where((F.col("frame_id") == first) & (F.col("channel") < channels)).orderBy("channel", "pos").select("channel", "x").collect()
    size = plane[0] * plane[1]
    planes = [np.array([r.x for r in values[k : k + size]]).reshape(plane) for k in range(0, len(values), size)]
    return [*out, _put(f"{folder}/channels.png", drawing.heatmaps(planes))]


def symbol_plot(symbols: DataFrame, bits: int, path: str) -> str:
    """Bars of how often each symbol of (table, q) occurs, over all tables."""
    found = {r["symbol"]: r["n"] for r in entropy.counts(symbols.select(F.lit(0).alias("table"), "q"), bits).collect()}
    counts = [float(found.get(s, 0)) for s in range(2**bits)]
    return _put(path, drawing.bars([s - 0.5 for s in range(2**bits + 1)], counts, title=f"Symbols of {bits} bits", across="symbol"))


def history_plots(history: list[dict], folder: str) -> list[str]:
    """Losses by epoch, by logarithm, and PSNR."""
    if not history:
        raise ValueError("a history without epochs")
    folder, epochs = folder.rstrip("/"), [r["epoch"] for r in history]
    curve = lambda *names: {n.replace("_", " "): [r[n] for r in history] for n in names}
    return [
        _put(f"{folder}/loss.svg", drawing.lines(epochs, curve("train_loss", "val_loss"), title="Loss", across="epoch", up="mean squared error", log=True)),
        _put(f"{folder}/psnr.svg", drawing.lines(epochs, curve("val_psnr"), title="PSNR of the validation frames", across="epoch", up="dB")),
    ]


def _images(frames: DataFrame, count: int) -> list[np.ndarray]:
    rows = frames.where("pixels is not null").orderBy("name").limit(count).collect()  # as many as are drawn
    return [np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3) for r in rows]


def sample_grid(frames: DataFrame, path: str, count: int = 16) -> str:
    """The first frames of (name, height, width, pixels) in a grid."""
    return _put(path, drawing.encode_png(drawing.grid(_images(frames, count))))


def comparison_grid(frames: DataFrame, others: list[DataFrame], path: str, count: int = 4) -> str:
    """The first frames above those of the same names in each of the others."""
    names = [r["name"] for r in frames.where("pixels is not null").orderBy("name").limit(count).select("name").collect()]
    return _put(path, drawing.comparison(_images(frames, count), [_images(o.where(F.col("name").isin(names)), count) for o in others]))
