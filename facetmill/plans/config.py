"""Settings of a run, and the names that follow from them."""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass, fields

LOSSES = ("BCE", "FOCAL", "ASYM", "FOCAL_SVDD", "ASYM_SVDD", "FOCAL_CENTER", "ASYM_CENTER")


@dataclass(frozen=True)
class Config:
    """One run. All fields can be set from the command line; ``no-`` turns a switch off."""

    experiment_size: int = 1_000_000
    chunk_size: int = 8
    batch_size: int = 512
    max_nodes: int = 15_000
    num_layers: int = 16
    num_heads: int = 32
    variance: int = 0
    loss: str = "BCE"
    warmup_epochs: int = 10
    total_epochs: int = 450
    patience: int = 15
    attention: bool = True
    face: bool = True
    barycentric: bool = True
    position: bool = False
    use_bucket: bool = True
    spd_bias: bool = True
    eval_face_noise_sigma: float = 0.0
    face_alpha: float = 1.0

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"loss must be one of {', '.join(LOSSES)}")

    @property
    def least_positives(self) -> int:
        """Positives a label needs in a sample."""
        return self.experiment_size // 1000 if self.experiment_size else 10_000

    @property
    def most_hops(self) -> int:
        return 55 if self.barycentric else 35

    @property
    def suffix(self) -> str:
        """The structures in use, for names of results."""
        return "_".join(n for n, on in (("face", self.face), ("bary", self.barycentric), ("attn", self.attention), ("pos", self.position)) if on) or "base"

    def checkpoint(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.suffix}/{self.loss.lower()}/var{self.variance}"

    def to_dict(self) -> dict:
        return asdict(self)


def parse(args: list[str] | None = None) -> Config:
    parser = argparse.ArgumentParser()
    for f in fields(Config):
        kind = type(f.default)
        extra = {"action": argparse.BooleanOptionalAction} if kind is bool else {"type": kind}
        parser.add_argument("--" + f.name.replace("_", "-"), dest=f.name, default=f.default, **extra)
    return Config(**vars(parser.parse_args(args)))
