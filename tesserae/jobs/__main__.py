"""Command lines of the jobs. Exit codes: 0 done, 1 it can't be done (the reason on stderr) or some files failed, 2 wrong arguments."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import container, latents, model, pixels, training
from ..sources import frames as frame_source
from ..sources import media, reports
from . import benchmark, coding, environment, plots, prepare
from .files import is_folder, make_folder, read_json, write_json


def _parser() -> argparse.ArgumentParser:
    d = Config()
    top = argparse.ArgumentParser(prog="python -m tesserae.jobs", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        p = jobs.add_parser(name, help=text, description=text, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
        for path in paths:
            p.add_argument(f"--{path}", required=True)
        return p

    p = job("prepare", "Videos or image sequences to PNG frames in three splits, and their manifest", "input", "output", "manifest")
    p.add_argument("--source-type", choices=["video", "image-sequence"])
    p.add_argument("--width", type=int, default=d.target_width)
    p.add_argument("--height", type=int, default=d.target_height)
    p.add_argument("--every-n-frames", type=int, default=d.every_n_frames)
    p.add_argument("--no-preserve-aspect-ratio", dest="preserve_aspect_ratio", action="store_false")
    for split, share in (("train", d.train_ratio), ("val", d.val_ratio), ("test", d.test_ratio)):
        p.add_argument(f"--{split}-ratio", type=float, default=share)
    p.add_argument("--seed", type=int, default=d.seed)

    p = job("inspect", "Counts and a grid of a split's first frames", "manifest", "output")
    p.add_argument("--split", choices=["train", "val", "test"], default="train")
    p.add_argument("--grid-size", type=int, default=16)

    p = job("train", "Train the autoencoder on a manifest's frames", "manifest", "checkpoints")
    p.add_argument("--epochs", type=int, default=1)
    p.add_argument("--batch-size", type=int, default=d.batch_size)
    p.add_argument("--learning-rate", type=float, default=1e-3)
    p.add_argument("--latent-channels", type=int, default=d.latent_channels)
    p.add_argument("--base-channels", type=int, default=d.base_channels)
    p.add_argument("--seed", type=int, default=d.seed)
    p.add_argument("--max-batches", type=int)
    p.add_argument("--resume")

    p = job("calibrate", "Fit quantization and entropy tables to the latents of a manifest's train frames", "manifest", "checkpoint", "output")
    p.add_argument("--bits", type=int, default=d.bits)
    p.add_argument("--mode", choices=["global", "per_channel"], default=d.mode)
    p.add_argument("--lower", type=float, default=d.lower_percentile)
    p.add_argument("--upper", type=float, default=d.upper_percentile)
    p.add_argument("--plots")

    p = job("benchmark", "Sizes, quality and times of calibrations on a split's frames", "manifest", "checkpoint", "output")
    p.add_argument("--calibration", nargs="+", required=True)
    p.add_argument("--split", choices=["train", "val", "test"], default="test")
    p.add_argument("--max-frames", type=int)

    job("encode", "Images to containers", "input", "output", "checkpoint", "calibration")
    p = job("decode", "Containers to PNG files", "input", "output", "checkpoint", "calibration")
    p.add_argument("--reference")
    job("reconstruct", "Images through the autoencoder, without coding", "input", "output", "checkpoint")
    job("plot-history", "Curves of a training run", "history", "output")
    job("environment", "Versions, and whether the scratch folder is shared")
    return top


def _frames(spark: SparkSession, manifest: str, split: str) -> DataFrame:
    index = frame_source.load_index(manifest, split)
    if missing := frame_source.missing_folders(index):
        raise ValueError(f"folders of {split} are missing: {', '.join(missing[:3])}")
    return pixels.decode_frames(frame_source.read_split(spark, manifest, split).drop("error_code"))


def _one_shape(frames: DataFrame) -> tuple[int, int, int]:
    """The frames' shape; ValueError where they differ or can't be decoded."""
    r = frames.agg(F.min("height").alias("a"), F.max("height").alias("b"), F.min("width").alias("c"), F.max("width").alias("d"), F.count("error_code").alias("bad")).first()
    if r.a is None or r.bad or (r.a, r.c) != (r.b, r.d):
        raise ValueError(f"{r.bad} frames can't be decoded" if r.bad else "the frames are of several sizes")
    return 3, r.a, r.c


def _prepare(spark: SparkSession, a: argparse.Namespace) -> int:
    if not is_folder(a.input):
        raise ValueError(f"no folder {a.input}")
    kind = {"video": "video", "image-sequence": "image_sequence", None: None}[a.source_type]
    manifest = prepare.prepare_dataset(
        spark, a.input, a.output, a.manifest, source_type=kind, target_width=a.width, target_height=a.height, every_n_frames=a.every_n_frames, preserve_aspect_ratio=a.preserve_aspect_ratio,
        train_ratio=a.train_ratio, val_ratio=a.val_ratio, test_ratio=a.test_ratio, seed=a.seed,
    )
    print("\n".join(prepare.report_lines(manifest)))
    return 0


def _inspect(spark: SparkSession, a: argparse.Namespace) -> int:
    frames = _frames(spark, a.manifest, a.split)
    _, height, width = _one_shape(frames)
    print(f"{a.split}: {len(frame_source.load_index(a.manifest, a.split))} frames of {height}x{width}")
    first = frames.where(F.col("ordinal") < a.grid_size).withColumn("name", F.col("ordinal"))
    print(plots.sample_grid(first, f"{a.output.rstrip('/')}/samples.png", a.grid_size))
    return 0


def _train(spark: SparkSession, a: argparse.Namespace) -> int:
    frames, held = _frames(spark, a.manifest, "train"), _frames(spark, a.manifest, "val")
    shape = _one_shape(frames)
    sizes = {"latent": a.latent_channels, "base": a.base_channels}
    if a.resume:
        run, _ = reports.load_run(a.resume, **sizes)
    else:
        run = training.Run(model.random_weights(a.seed, **sizes), training.Adam(a.learning_rate))
    make_folder(a.checkpoints)
    home = a.checkpoints.rstrip("/")

    def saved(run: training.Run, better: bool) -> None:
        reports.save_run(f"{home}/latest.npz", run, {"sizes": sizes})
        if better:
            reports.save_run(f"{home}/best.npz", run, {"sizes": sizes})
        write_json(f"{home}/history.json", run.history)
        r = run.history[-1]
        print(f"epoch {r['epoch']}: train {r['train_loss']:.6f}, val {r['val_loss']:.6f}, {r['val_psnr']:.2f} dB, {r['elapsed_seconds']:.1f} s")

    training.train(frames, held, run, shape=shape, epochs=a.epochs, batch_size=a.batch_size, seed=a.seed, id_col="ordinal", max_batches=a.max_batches, saved=saved)
    return 0


def _calibrate(spark: SparkSession, a: argparse.Namespace) -> int:
    weights = coding.load_model(a.checkpoint)
    frames = _frames(spark, a.manifest, "train")
    shape = _one_shape(frames)
    plane = shape[1] // model.DOWN, shape[2] // model.DOWN
    z = coding.latents_of(coding.check_size(frames), weights).select("ordinal", "latent")
    rows = latents.to_long(z, id_col="ordinal", array_col="latent", plane=plane[0] * plane[1])
    codec = container.fit_codec(rows, bits=a.bits, mode=a.mode, lower=a.lower, upper=a.upper, plane=plane, image=shape)
    make_folder(a.output.rpartition("/")[0])
    media.write_calibration(codec, a.output, frames=frames.count(), lower_percentile=a.lower, upper_percentile=a.upper)
    if a.plots:
        make_folder(a.plots)
        print("\n".join(plots.latent_plots(rows, a.plots, plane=plane)))
    print(f"{len(codec.scales)} scales, {codec.shape[0]} tables of {2**a.bits} symbols: {a.output}")
    return 0


def _benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    weights = coding.load_model(a.checkpoint)
    frames = _frames(spark, a.manifest, a.split)
    if a.max_frames is not None:
        frames = frames.where(F.col("ordinal") < a.max_frames)
    shape = _one_shape(frames)
    if shape[1] % model.DOWN or shape[2] % model.DOWN:
        raise ValueError(f"frames of {shape[1]}x{shape[2]} don't fit the model")
    rows = [r.asDict() for r in benchmark.benchmark(spark, frames, weights, a.calibration, image=shape).collect()]
    write_json(a.output, rows)
    for r in rows:
        print(f"{r['bits']} bits, {r['mode']}: {r['frames']} frames, {r['psnr_db']:.3f} dB, {r['mean_total_bpp']:.4f} bpp, {r['mean_compression_ratio']:.2f} times smaller, {r['clipped_percent']:.3f}% clipped")
    return 0


def _environment(spark: SparkSession, a: argparse.Namespace) -> int:
    lines, good = environment.environment(spark)
    print("\n".join(lines))
    return int(not good)


def _reported(report: DataFrame, *columns: str) -> int:
    """Prints the means of a report by file and how many files failed; 1 if any did, or there were none."""
    report = report.persist()
    r = report.agg(F.count("*").alias("files"), F.count("error_code").alias("failed"), *(F.avg(c).alias(c) for c in columns)).first()
    print(f"{r.files} files, {r.failed} failed" + "".join(f", {c} {r[c]:.4f}" for c in columns if r[c] is not None))
    for bad in report.where("error_code is not null").orderBy("name").limit(20).collect():
        print(f"{bad['name']}: {bad.error_code}", file=sys.stderr)
    report.unpersist()
    return int(r.failed > 0 or r.files == 0)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"tesserae {a.job}").getOrCreate()
    try:
        if a.job == "encode":
            return _reported(coding.encode_images(spark, a.input, a.output, checkpoint=a.checkpoint, calibration=a.calibration), "total_bpp", "compression_ratio")
        if a.job == "decode":
            return _reported(coding.decode_containers(spark, a.input, a.output, checkpoint=a.checkpoint, calibration=a.calibration, reference=a.reference), "mse", "psnr")
        if a.job == "reconstruct":
            return _reported(coding.reconstruct_images(spark, a.input, a.output, checkpoint=a.checkpoint), "mse", "psnr")
        if a.job == "plot-history":
            history = read_json(a.history)
            if history is None:
                raise ValueError(f"no history {a.history}")
            print("\n".join(plots.history_plots(history, a.output)))
            return 0
        return {"prepare": _prepare, "inspect": _inspect, "train": _train, "calibrate": _calibrate, "benchmark": _benchmark, "environment": _environment}[a.job](spark, a)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
