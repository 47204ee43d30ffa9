"""Settings of a run, with JSON overrides."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    # The defaults of the format's tools.
    target_width: int = 256
    target_height: int = 256
    every_n_frames: int = 1
    preserve_aspect_ratio: bool = True
    train_ratio: float = 0.8
    val_ratio: float = 0.1
    test_ratio: float = 0.1
    seed: int = 42
    batch_size: int = 8
    latent_channels: int = 64
    base_channels: int = 32
    bits: int = 8
    mode: str = "per_channel"
    lower_percentile: float = 0.1
    upper_percentile: float = 99.9
    raw_dir: Path = Path("data/raw")
    frames_dir: Path = Path("data/frames")

    @classmethod
    def unknown(cls, given) -> list[str]:
        """Those of the keys that aren't settings, sorted."""
        return sorted(set(given) - {f.name for f in fields(cls)})

    @classmethod
    def unknown_rows(cls, rows, key: str):
        """Those rows of a DataFrame whose key isn't a setting; null isn't one, either."""
        return rows.where(~rows[key].isin(*(f.name for f in fields(cls))) | rows[key].isNull())

    @classmethod
    def from_json(cls, path: str | Path) -> Config:
        """Defaults with the file's values in their place; keys that aren't settings raise ValueError."""
        given = json.loads(Path(path).read_text())
        if unknown := cls.unknown(given):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: Path(v) if isinstance(getattr(cls, k), Path) else v for k, v in given.items()})

    def to_dict(self) -> dict:
        return {k: str(v) if isinstance(v, Path) else v for k, v in asdict(self).items()}
