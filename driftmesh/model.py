"""Records and parameters shared by the operators."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

SAMPLE = "trajectory_idx long, trajectory_id long, seq long, x long, y long, t long"
DIMS = ("x", "y", "t")


@dataclass(frozen=True)
class Level:
    """Bits dropped from each coordinate when the grid is coarsened."""

    x: int
    y: int
    t: int

    @classmethod
    def parse(cls, text: str) -> Level:
        """From a string such as ``5,5,3``."""
        return cls(*(int(part) for part in text.split(",")))


@dataclass(frozen=True)
class Box:
    """Half-open in both dimensions: left <= x < right, top <= y < bottom."""

    left: int
    top: int
    right: int
    bottom: int

    @classmethod
    def parse(cls, text: str) -> Box:
        return cls(*(int(part) for part in text.split(",")))


@dataclass(frozen=True)
class Viewport:
    """A window on the grid, in grid units, and the pixels it is shown on."""

    width: int
    height: int
    top_x: int
    top_y: int
    bottom_x: int
    bottom_y: int
    resolution: int = 1
    mask: int = 2**31 - 1


@dataclass
class GeneratorConfig:
    """Settings of the synthetic data generator."""

    # The defaults that configurations count on.
    movement: str = "random"
    grid_size: int = 64
    n_groups: int = 3
    group_size: int = 20
    avg_distance: float = 3
    deviation: list = field(default_factory=lambda: [[0, 0.5], [1, 0.3], [2, 0.15], [3, 0.05]])
    noise: float = 0.2
    steps: int = 20
    stop: float = 0.2
    max_speed: float = 30
    max_t: int = 4096
    time_mult: int = 1
    time_jitter: list = field(default_factory=lambda: [[0.0, 1.0]])
    spiral_radius_base: list = field(default_factory=lambda: [1.0002, 1.00025])
    spiral_max_distance: int = 300
    nested_spiral_chunks: int = 3
    nested_spiral_overlap: int = 5
    seed: int = 1234

    def n_singletons(self) -> int:
        """Noise objects such that they make up the wanted share of all."""
        if self.noise >= 1.0:
            raise ValueError("noise must be below 1")
        return int(self.noise * self.n_groups * self.group_size / (1.0 - self.noise))

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @classmethod
    def load(cls, text: str) -> GeneratorConfig:
        return cls(**json.loads(text))
