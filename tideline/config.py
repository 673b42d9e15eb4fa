"""Settings as frozen objects, with lookup by dotted path."""

from __future__ import annotations

from dataclasses import dataclass, field

from tideline.operators.elo import EloRules


@dataclass(frozen=True)
class Features:
    """Windows, halflife and neighbour counts of the published tuned configuration."""

    windows: tuple[int, ...] = (5, 10, 20)
    h2h_margin_games: int = 3
    h2h_win_games: int = 5
    naive_window: int = 10
    fingerprint_window: int = 37
    fingerprint_halflife: float = 13.2
    min_games: int = 5
    neighbours: int = 81
    least_neighbours: int = 21
    full_confidence: int = 82


@dataclass(frozen=True)
class Config:
    elo: EloRules = field(default_factory=EloRules)
    features: Features = field(default_factory=Features)
    composite_weight: float = 0.5


def get_value(config, path: str, default=None):
    """config.a.b for 'a.b'; default where a part is missing."""
    at = config
    for name in path.split("."):
        if isinstance(at, dict) and name in at:
            at = at[name]
        elif hasattr(at, name):
            at = getattr(at, name)
        else:
            return default
    return at
