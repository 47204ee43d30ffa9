"""The convolutional encoder and decoder as array operations, for use inside mapInPandas; weights are a dict of arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

KERNEL, STRIDE, PAD, DOWN = 4, 2, 1, 16


def widths(in_channels: int = 3, latent: int = 64, base: int = 32) -> list[int]:
    return [in_channels, base, 2 * base, 4 * base, latent]


def parameter_count(in_channels: int = 3, latent: int = 64, base: int = 32) -> int:
    w = widths(in_channels, latent, base)
    down = sum(a * b * KERNEL**2 + b for a, b in zip(w, w[1:], strict=False))
    up = sum(a * b * KERNEL**2 + b for a, b in zip(w[::-1], w[::-1][1:], strict=False))
    return down + up


def random_weights(seed: int, **sizes) -> dict[str, np.ndarray]:
    rng, w = np.random.default_rng(seed), widths(**sizes)
    out = {}
    for name, chain in (("down", w), ("up", w[::-1])):
        for i, (a, b) in enumerate(zip(chain, chain[1:], strict=False)):
            bound = 1 / np.sqrt((a if name == "down" else b) * KERNEL**2)
            shape = (b, a, KERNEL, KERNEL) if name == "down" else (a, b, KERNEL, KERNEL)
            out[f"{name}{i}.weight"], out[f"{name}{i}.bias"] = rng.uniform(-bound, bound, shape), rng.uniform(-bound, bound, b)
    return out


def conv(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """[B, C, H, W] -> [B, D, H/2, W/2]: kernel 4, stride 2, padding 1."""
    padded = np.pad(x, ((0, 0), (0, 0), (PAD, PAD), (PAD, PAD)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, (KERNEL, KERNEL), axis=(2, 3))[:, :, ::STRIDE, ::STRIDE]
    return np.einsum("bchwij,dcij->bdhw", windows, weight, optimize=True) + bias[:, None, None]


def conv_transposed(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """[B, C, H, W] -> [B, D, 2H, 2W], the adjoint of conv."""
    b, _, h, w = x.shape
    spread = np.einsum("bchw,cdij->bdhwij", x, weight, optimize=True)
    out = np.zeros((b, weight.shape[1], STRIDE * h + 2 * PAD, STRIDE * w + 2 * PAD))
    for i in range(KERNEL):
        for j in range(KERNEL):
            out[:, :, i : i + STRIDE * h : STRIDE, j : j + STRIDE * w : STRIDE] += spread[..., i, j]
    return out[:, :, PAD:-PAD, PAD:-PAD] + bias[:, None, None]


def encode(x: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    if x.ndim != 4 or x.shape[1] != weights["down0.weight"].shape[1]:
        raise ValueError(f"frames are [B, {weights['down0.weight'].shape[1]}, H, W], not {x.shape}")
    if x.shape[2] % DOWN or x.shape[3] % DOWN:
        raise ValueError(f"height and width must be multiples of {DOWN}, not {x.shape[2]}x{x.shape[3]}")
    for i in range(4):
        x = conv(x, weights[f"down{i}.weight"], weights[f"down{i}.bias"])
        x = np.maximum(x, 0) if i < 3 else x
    return x


def decode(z: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    if z.ndim != 4 or z.shape[1] != weights["up0.weight"].shape[0]:
        raise ValueError(f"latents are [B, {weights['up0.weight'].shape[0]}, H, W], not {z.shape}")
    for i in range(4):
        z = conv_transposed(z, weights[f"up{i}.weight"], weights[f"up{i}.bias"])
        z = np.maximum(z, 0) if i < 3 else 1 / (1 + np.exp(-z))
    return z


def encode_table(frames: DataFrame, weights: dict[str, np.ndarray], *, id_col: str, array_col: str, shape: tuple[int, int, int]) -> DataFrame:
    """(frame_id, latent array) of frames given as flat arrays in channel-major order; weights are read from a broadcast once a worker."""
    shared = frames.sparkSession.sparkContext.broadcast(weights)

    def task(parts):
        for pdf in parts:
            if len(pdf):
                z = encode(np.stack([np.asarray(a, float) for a in pdf["a"]]).reshape(-1, *shape), shared.value)
                yield pd.DataFrame({"frame_id": pdf["frame_id"], "latent": list(z.reshape(len(pdf), -1))})

    return frames.selectExpr(f"cast({id_col} as long) as frame_id", f"{array_col} as a").mapInPandas(task, "frame_id long, latent array<double>")
