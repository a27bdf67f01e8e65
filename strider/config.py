"""Simulation parameters and their JSON document."""

from __future__ import annotations

import argparse
import dataclasses
import json
import math
from dataclasses import dataclass, field

# Defaults of the simulation's parameters, category weights and metres per degree.
DAILY_WEIGHTS = (0.11, 0.12, 0.13, 0.145, 0.165, 0.195, 0.135)
CATEGORY_WEIGHTS = {
    "farmers": 0.60,
    "davidjones": 0.45,
    "hm": 0.35,
    "woolworths": 0.70,
    "jbhifi": 0.30,
    "foodcourt": 0.75,
    "noelleeming": 0.30,
    "archiebrothers": 0.35,
    "rebelsport": 0.35,
    "specialty": 0.12,
}
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
LAT_DEG_TO_M = 111000.0
LON_DEG_TO_M = 88800.0
ROUTING_MODES = ("shortest", "segment_logit")
SIMILARITY_METRICS = ("jaccard", "cosine", "overlap", "overlap_coef")
MIN_STEP_M = 0.5


@dataclass(frozen=True)
class SimConfig:
    weekly_visits: int = 200_000
    weekly_uniques: int = 123_000
    daily_weights: tuple[float, ...] = DAILY_WEIGHTS
    min_visits: int = 2
    max_visits: int = 4
    walk_speed: float = 1.3
    decay_exponent: float = 1.3
    routing_mode: str = "segment_logit"
    beta_progress: float = 0.08
    randomness: float = 1.0
    zone_boost: float = 0.35
    beta_vertical: float = 0.5
    view_dist: float = 15.0
    cone_angle: float = 60.0
    show_graph: bool = False
    category_weights: dict[str, float] = field(default_factory=lambda: dict(CATEGORY_WEIGHTS))
    active_panel_ids: tuple[str, ...] | None = None  # None: all
    step_m: float = 2.0
    max_hops: int = 500
    zone_radius_m: float = 15.0
    zone_anchor: str = "escalator_lv2_4"
    zone_level: str = "2"
    seed: int = 42
    #: "grid": panels of the 3x3 cells around a sample; "floor": all panels of its floor.
    candidates: str = "floor"

    def __post_init__(self):
        if self.routing_mode not in ROUTING_MODES:
            raise ValueError(f"routing mode {self.routing_mode!r}")
        if self.candidates not in ("grid", "floor"):
            raise ValueError(f"candidates {self.candidates!r}")
        if not 1 <= self.min_visits <= self.max_visits:
            raise ValueError("min_visits must be between 1 and max_visits")
        object.__setattr__(self, "step_m", max(MIN_STEP_M, self.step_m))

    @property
    def cell_m(self) -> float:
        """Grid cells as wide as the view, so that 3x3 cells hold every panel in range."""
        return self.view_dist

    @property
    def cos_cone(self) -> float:
        return math.cos(math.radians(self.cone_angle))


#: JSON key -> field. The sample step, hop cap, zone and seed are not part of the document.
KEYS = {
    "weeklyVisits": "weekly_visits",
    "weeklyUniques": "weekly_uniques",
    "dailyWeights": "daily_weights",
    "minVisits": "min_visits",
    "maxVisits": "max_visits",
    "walkSpeed": "walk_speed",
    "decayExponent": "decay_exponent",
    "routingMode": "routing_mode",
    "routeBetaProgress": "beta_progress",
    "routeRandomness": "randomness",
    "routeZoneBoost": "zone_boost",
    "routeBetaVertical": "beta_vertical",
    "viewDist": "view_dist",
    "coneAngle": "cone_angle",
    "showGraph": "show_graph",
    "categoryWeights": "category_weights",
    "activePanelIds": "active_panel_ids",
}
LEGACY = {"totalAgents": "weeklyVisits"}
#: Written, not read back.
EXPORT_ONLY = ("dailyWeights",)


def to_json(config: SimConfig, timestamp: str | None = None) -> str:
    """K5: the configuration document."""
    out = {"timestamp": timestamp} if timestamp else {}
    for key, name in KEYS.items():
        value = getattr(config, name)
        if key == "activePanelIds":
            value = list(value or ())
        elif isinstance(value, tuple):
            value = list(value)
        out[key] = value
    return json.dumps(out, indent=2)


def from_json(text: str, base: SimConfig | None = None) -> SimConfig:
    """Applies the keys that are present; category weights are rounded to whole percent, as sliders hold them."""
    base, doc = base or SimConfig(), json.loads(text)
    for old, new in LEGACY.items():
        if new not in doc and old in doc:
            doc[new] = doc[old]
    changes: dict = {}
    for key, name in KEYS.items():
        if key not in doc or key in EXPORT_ONLY:
            continue
        value = doc[key]
        if key == "categoryWeights":
            value = base.category_weights | {k: math.floor(v * 100 + 0.5) / 100 for k, v in value.items()}
        elif key == "activePanelIds":
            value = tuple(str(v) for v in value)
        else:
            value = type(getattr(base, name))(value)
        changes[name] = value
    if "min_visits" in changes and "max_visits" not in changes:
        changes["max_visits"] = max(base.max_visits, changes["min_visits"])
    if "max_visits" in changes and "min_visits" not in changes:
        changes["min_visits"] = min(base.min_visits, changes["max_visits"])
    if changes.get("min_visits", 0) > changes.get("max_visits", math.inf):
        changes["max_visits"] = changes["min_visits"]
    return dataclasses.replace(base, **changes)


def from_args(argv: list[str] | None = None) -> tuple[SimConfig, argparse.Namespace]:
    """Command line of a weekly run; 0 trips mean the configured week."""
    p = argparse.ArgumentParser(description="Weekly audience simulation")
    p.add_argument("--panels", required=True)
    p.add_argument("--graph", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config", help="configuration document")
    p.add_argument("--trips", type=int, default=0)
    p.add_argument("--partitions", type=int, default=0)
    p.add_argument("--routing-mode", choices=ROUTING_MODES)
    p.add_argument("--step-meters", type=float)
    args = p.parse_args(argv)
    config = from_json(open(args.config).read()) if args.config else SimConfig()
    changes = {"weekly_visits": args.trips or None, "routing_mode": args.routing_mode, "step_m": args.step_meters}
    return dataclasses.replace(config, **{k: v for k, v in changes.items() if v is not None}), args
