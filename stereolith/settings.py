"""What a project starts with where nothing else is set."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """The defaults of the parameters that computations take."""

    hint_line_interval: float = 20.0  # pixels
    grid_spacing: float = 0.1
    nudge_pixels: float = 0.3
    most_corners: int = 2000
    least_line_corners: int = 4  # a line has more
    corner_tolerance: float = 0.2  # of a step
    corner_margin: float = 4.0  # pixels
    step_amount: float = 10.0
    step_unit: str = "frames"
    rates: tuple[float, float] = (0.33, 2.0)
    exact_duration: float = 5.0  # seconds
    random_duration: tuple[float, float] = (2.0, 10.0)
    replay_duration: float = 2.0
    replay_rate: float = 1.0


DEFAULTS = Settings()
