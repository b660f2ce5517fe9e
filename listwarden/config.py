"""Screening parameters. Frozen values handed to the operators; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Names that always need a second identifier.
COMMON_NAMES = (
    "Mohamed Ali",
    "Mohammed Ali",
    "Maria Garcia",
    "Maria Rodriguez",
    "Li Wei",
    "Kim Park",
    "John Smith",
    "Jose Garcia",
    "Juan Martinez",
    "Ahmed Hassan",
    "Chen Wei",
    "Wang Wei",
)


@dataclass(frozen=True)
class AdaptiveThresholds:
    """Thresholds that replace ``short_name_threshold`` for short names, by script."""

    enabled: bool = True
    chinese: float = 75
    arabic: float = 75
    cyrillic: float = 75
    latin_initials: float = 75


@dataclass(frozen=True)
class Weights:
    name: float = 1.0
    document: float = 0.0
    dob: float = 0.0
    nationality: float = 0.0
    address: float = 0.0

    def total(self) -> float:
        return self.name + self.document + self.dob + self.nationality + self.address


@dataclass(frozen=True)
class Layers:
    exact: float = 100
    high: float = 85
    moderate: float = 70
    low: float = 60


@dataclass(frozen=True)
class Recommendations:
    clear: float = 60
    review: float = 85
    escalate: float = 95


@dataclass(frozen=True)
class InputRules:
    name_min_length: int = 2
    name_max_length: int = 200
    document_max_length: int = 50
    allow_unicode_names: bool = True
    blocked_characters: str = "<>{}[]|\\;`$"


@dataclass(frozen=True)
class JoinLimits:
    """Physical limits of the joins. They choose a strategy and never change a result.

    broadcast_bytes: a side is broadcast only after its measured size is below this.
    block_rows: names of one length that may share a join block on the shuffled path.
    """

    broadcast_bytes: int = 64 * 1024 * 1024
    block_rows: int = 20_000


@dataclass(frozen=True)
class ScreeningConfig:
    name_threshold: float = 75
    short_name_threshold: float = 75
    adaptive: AdaptiveThresholds = field(default_factory=AdaptiveThresholds)
    common_names: tuple[str, ...] = COMMON_NAMES
    weights: Weights = field(default_factory=Weights)
    layers: Layers = field(default_factory=Layers)
    recommendations: Recommendations = field(default_factory=Recommendations)
    input_rules: InputRules = field(default_factory=InputRules)
    limits: JoinLimits = field(default_factory=JoinLimits)
    match_limit: int = 10
    malformed_percent: float = 1.0
    xsd_strictness: str = "normal"
    freshness_days: int = 7
    algorithm_version: str = "2.0.0"
    algorithm_name: str = "Multi-Layer Fuzzy Matcher"

    def __post_init__(self) -> None:
        if abs(self.weights.total() - 1.0) > 0.01:
            raise ValueError(f"weights must sum to 1, got {self.weights.total()}")
        r = self.recommendations
        if not r.clear < r.review < r.escalate:
            raise ValueError("recommendation thresholds must rise: clear < review < escalate")
        if not 0 < self.layers.low <= self.layers.moderate <= self.layers.high <= self.layers.exact:
            raise ValueError("layer thresholds must rise from above 0 to 100")
        if self.xsd_strictness not in ("strict", "normal", "lenient"):
            raise ValueError(f"unknown strictness {self.xsd_strictness}")

    def with_(self, **changes) -> "ScreeningConfig":
        return replace(self, **changes)


DEFAULT = ScreeningConfig()

# The built-in fallback profile, used when no settings file is given.
FALLBACK = ScreeningConfig(
    name_threshold=85,
    short_name_threshold=95,
    adaptive=AdaptiveThresholds(chinese=85, arabic=90, cyrillic=90, latin_initials=98),
    common_names=(),
    weights=Weights(name=0.40, document=0.30, dob=0.15, nationality=0.10, address=0.05),
)
