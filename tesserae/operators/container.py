"""The bitstream container: a fixed header, a parameter block, and the coded payload; packed and parsed a batch at a time."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import coder

# Fixed values of the format.
MAGIC = b"NVC1"
SUFFIX = ".nvc"
VERSION = 1
CODER_ID = 1
MODES = {"global": 0, "per_channel": 1}
#: magic, version, bits, mode, coder; image width, height, channels; latent channels, height, width; symbols, parameters, payload length; model id
FIXED = struct.Struct("<4sBBBBHHBHHHIHI8s")

FIELDS = ["bits", "mode", "image_width", "image_height", "image_channels", "latent_channels", "latent_height", "latent_width", "symbol_count", "payload_length", "model_id", "scales", "zero_points"]
HEADER = T.StructType(
    [T.StructField("bits", T.IntegerType()), T.StructField("mode", T.StringType())]
    + [T.StructField(f, T.IntegerType()) for f in FIELDS[2:8]]
    + [T.StructField("symbol_count", T.LongType()), T.StructField("payload_length", T.LongType()), T.StructField("model_id", T.StringType())]
    + [T.StructField(f, T.ArrayType(T.FloatType())) for f in FIELDS[11:]]
)
PARSED = T.StructType([T.StructField("header", HEADER), T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())])


class FormatError(ValueError):
    """A container that can't be read or written; ``code`` names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def header_size(parameters: int) -> int:
    return FIXED.size + 8 * parameters


def pack_header(h: dict) -> bytes:
    """Bytes of a header given by FIELDS; values that don't fit their width raise FormatError."""
    scales, zeros, model = h["scales"], h["zero_points"], bytes.fromhex(h["model_id"])
    if h["mode"] not in MODES:
        raise FormatError("mode", f"unknown mode {h['mode']!r}")
    if len(scales) != len(zeros):
        raise FormatError("parameter_count", f"{len(scales)} scales and {len(zeros)} zero points")
    if len(model) != 8:
        raise FormatError("model_id", f"a model id has 8 bytes, not {len(model)}")
    try:
        fixed = FIXED.pack(MAGIC, VERSION, h["bits"], MODES[h["mode"]], CODER_ID, *(h[f] for f in FIELDS[2:9]), len(scales), h["payload_length"], model)
    except struct.error as e:
        raise FormatError("field_range", str(e)) from None
    return fixed + np.column_stack((scales, zeros)).astype("<f4").tobytes()


def unpack_header(data: bytes) -> tuple[dict, int]:
    """(header, its size); the first broken rule raises FormatError."""
    if len(data) < FIXED.size:
        raise FormatError("short", f"{len(data)} bytes hold no header of {FIXED.size}")
    magic, version, bits, mode, coder_id, width, height, planes, c, y, x, symbols, n, length, model = FIXED.unpack_from(data)
    names = {v: k for k, v in MODES.items()}
    wanted = {0: 1, 1: c}.get(mode)
    rules = (
        ("magic", magic == MAGIC, f"starts with {magic!r}"),
        ("version", version == VERSION, f"version {version}"),
        ("coder", coder_id == CODER_ID, f"coder {coder_id}"),
        ("mode", mode in names, f"mode {mode}"),
        ("bits", 1 <= bits <= 16, f"{bits} bits"),
        ("dimensions", min(width, height, planes, c, y, x) > 0, f"dimensions {width}x{height}x{planes}, {c}x{y}x{x}"),
        ("symbol_count", symbols == c * y * x, f"{symbols} symbols for {c}x{y}x{x}"),
        ("parameter_count", n == wanted, f"{n} parameters instead of {wanted}"),
        ("parameter_block", len(data) >= header_size(n), "the parameter block is cut off"),
    )
    for code, holds, message in rules:
        if not holds:
            raise FormatError(code, message)
    table = np.frombuffer(data, "<f4", 2 * n, FIXED.size).reshape(n, 2)
    if not (table[:, 0] > 0).all():
        raise FormatError("scale", "a scale isn't positive")
    values = (bits, names[mode], width, height, planes, c, y, x, symbols, length, model.hex(), table[:, 0].tolist(), table[:, 1].tolist())
    return dict(zip(FIELDS, values, strict=True)), header_size(n)


def split(data: bytes) -> tuple[dict, bytes]:
    """(header, payload) of a whole container."""
    header, at = unpack_header(data)
    have, want = len(data) - at, header["payload_length"]
    if have < want:
        raise FormatError("payload_cut", f"{have} of {want} payload bytes")
    if have > want:
        raise FormatError("trailing", f"{have - want} bytes after the payload")
    return header, data[at:]


def join(header: dict, payload: bytes) -> bytes:
    if header["payload_length"] != len(payload):
        raise FormatError("payload_length", f"the header says {header['payload_length']} bytes, there are {len(payload)}")
    return pack_header(header) + payload


def parse(data: Column) -> Column:
    """struct(header, payload, error) of a binary column; error is the code of the broken rule, or null."""

    @F.pandas_udf(PARSED)
    def udf(column: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in column:
            try:
                header, payload = split(bytes(blob)) if blob is not None else (None, None)
                rows.append((header, payload, None if blob is not None else "missing"))
            except FormatError as e:
                rows.append((None, None, e.code))
        return pd.DataFrame(rows, columns=["header", "payload", "error"], dtype=object)

    return udf(data)


class Codec:
    """Frozen parameters and tables: what an encoder and its decoder must have in common. Bounded by channels x 2^bits."""

    def __init__(self, *, bits: int, mode: str, shape: tuple[int, int, int], image: tuple[int, int, int], scales, zero_points, frequencies, model_id: str):
        self.bits, self.mode, self.shape, self.image, self.model_id = bits, mode, shape, image, model_id
        self.scales, self.zero_points = np.asarray(scales, float), np.asarray(zero_points, float)
        table = np.asarray(frequencies, np.int64)
        if table.shape != (shape[0], 2**bits):
            raise ValueError(f"tables of {table.shape} for {shape[0]} channels of {bits} bits")
        self.cumulative = np.concatenate((np.zeros((len(table), 1), np.int64), np.cumsum(table, axis=1)), axis=1)
        self.tables = np.repeat(np.arange(shape[0]), shape[1] * shape[2])
        self.parameter = self.tables if mode == "per_channel" else np.zeros(len(self.tables), np.int64)

    def symbols(self, x: np.ndarray) -> np.ndarray:
        """Symbols of rows of values in channel-major order."""
        at = np.rint(x / self.scales[self.parameter]) + self.zero_points[self.parameter]
        return np.clip(at, 0, 2**self.bits - 1).astype(np.int64)

    def values(self, q: np.ndarray) -> np.ndarray:
        return (q - self.zero_points[self.parameter]) * self.scales[self.parameter]

    def header(self, payload: bytes) -> dict:
        values = (self.bits, self.mode, self.image[2], self.image[1], self.image[0], *self.shape, len(self.tables), len(payload), self.model_id, self.scales.tolist(), self.zero_points.tolist())
        return dict(zip(FIELDS, values, strict=True))

    def encode(self, rows: list[np.ndarray]) -> list[bytes]:
        payloads = coder.encode_frames(list(self.symbols(np.stack(rows))), self.cumulative, [self.tables] * len(rows)) if rows else []
        return [join(self.header(p), p) for p in payloads]

    def decode(self, blobs: list[bytes]) -> list[np.ndarray]:
        parts = [split(b) for b in blobs]
        for header, _ in parts:
            if header["model_id"] != self.model_id or header["bits"] != self.bits:
                raise FormatError("model", f"coded with model {header['model_id']}, not {self.model_id}")
        return coder.decode_frames([p for _, p in parts], self.cumulative, [self.tables] * len(parts))


def encode(frames: DataFrame, codec: Codec, *, array_col: str, to: str = "data") -> DataFrame:
    """frames with their containers. Stateless, so it also runs on a stream."""

    @F.pandas_udf(T.BinaryType())
    def udf(column: pd.Series) -> pd.Series:
        return pd.Series(codec.encode([np.asarray(x, float) for x in column]), dtype=object)

    return frames.withColumn(to, udf.asNondeterministic()(F.col(array_col)))


def decode(frames: DataFrame, codec: Codec, *, data_col: str = "data", to: str = "symbols") -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def udf(column: pd.Series) -> pd.Series:
        return pd.Series([x.astype(np.int32) for x in codec.decode([bytes(b) for b in column])], dtype=object)

    return frames.withColumn(to, udf.asNondeterministic()(F.col(data_col)))


def fit_codec(rows: DataFrame, *, bits: int, mode: str = "per_channel", lower: float = 0.1, upper: float = 99.9, plane: tuple[int, int] = (1, 1), image: tuple[int, int, int] | None = None, ranges: DataFrame | None = None) -> Codec:
    """Calibrate on (frame_id, channel, pos, x): percentile parameters, then tables of the symbols they give. What comes to the driver has channels x 2^bits rows at most.

    A channel has plane[0] x plane[1] positions, which share its parameters and its table. Ranges may be given, as they don't depend on bits.
    """
    from . import entropy
    from . import quantize as qz

    qz.check(bits, mode)
    table = qz.params(qz.percentile_ranges(rows, mode, lower, upper) if ranges is None else ranges, bits)
    found = table.orderBy("channel").toPandas()
    q = qz.quantize(rows, table, bits, mode).select(F.col("channel").alias("table"), "q")
    freq = entropy.frequencies(entropy.counts(q, bits))
    grid = freq.orderBy("table", "symbol").toPandas()
    channels = int(grid["table"].nunique())
    ids = entropy.model_id(freq, bits).first()["model_id"]
    return Codec(
        bits=bits, mode=mode, shape=(channels, *plane), image=image or (1, 1, channels), scales=found["scale"], zero_points=found["zero_point"],
        frequencies=grid["freq"].to_numpy().reshape(channels, 2**bits), model_id=ids,
    )
