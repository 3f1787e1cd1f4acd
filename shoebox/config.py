"""Settings of scanning, scoring and selection, with their presets and checks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class ScanConfig:
    # The photo formats and the names that a scan leaves out.
    extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".heic", ".heif")
    ignore: tuple[str, ...] = (".*", "__MACOSX", "node_modules", ".git", ".DS_Store", "Thumbs.db", ".txt", ".json", ".xml")
    min_bytes: int = 1024
    max_bytes: int | None = None


@dataclass(frozen=True)
class QualityConfig:
    sharpness: float = 0.6
    exposure: float = 0.4
    composition: float = 0.0
    acceptable: float = 50.0
    high: float = 70.0
    max_side: int = 1024
    cache_days: int = 365
    version: str = "v1.0"

    def __post_init__(self) -> None:
        if abs(self.sharpness + self.exposure + self.composition - 1) > 0.01:
            raise ValueError("the weights must sum to 1")
        if self.composition:
            raise ValueError("there is no composition score to weigh")
        if not self.high > self.acceptable:
            raise ValueError("the high tier must lie above the acceptable one")


@dataclass(frozen=True)
class EmotionalConfig:
    """Weights cap the four components; they don't rescale them."""

    face_presence: float = 30.0
    emotion: float = 40.0
    intimacy: float = 20.0
    engagement: float = 10.0
    high: float = 70.0
    medium: float = 40.0
    confidence: float = 0.5
    min_size: float = 0.05
    max_size: float = 0.95
    max_faces: int = 20
    very_close: float = 1.5
    close: float = 3.0
    moderate: float = 5.0
    version: str = "v1.0"

    def __post_init__(self) -> None:
        if abs(self.face_presence + self.emotion + self.intimacy + self.engagement - 100) > 1:
            raise ValueError("the component weights must sum to 100")
        if not self.high > self.medium:
            raise ValueError("the high tier must lie above the medium one")
        if not 0 <= self.confidence <= 1:
            raise ValueError("a confidence lies between 0 and 1")

    @classmethod
    def strict(cls) -> EmotionalConfig:
        return cls(confidence=0.7, high=80.0, medium=50.0)

    @classmethod
    def permissive(cls) -> EmotionalConfig:
        return cls(confidence=0.4, high=60.0, medium=30.0)


@dataclass(frozen=True)
class CurationConfig:
    quality_weight: float = 0.4
    emotional_weight: float = 0.6
    strategy: str = "balanced"
    similarity: float = 0.85
    min_combined: float = 0.0
    size: int = 12

    def __post_init__(self) -> None:
        if not (0 <= self.quality_weight <= 1 and 0 <= self.emotional_weight <= 1):
            raise ValueError("a weight lies between 0 and 1")
        if abs(self.quality_weight + self.emotional_weight - 1) > 0.01:
            raise ValueError("the weights must sum to 1")
        if not 0 <= self.similarity <= 1:
            raise ValueError("a similarity lies between 0 and 1")

    def with_strategy(self, strategy: str) -> CurationConfig:
        """Another branch under the same weights."""
        return replace(self, strategy=strategy)


STRATEGIES = {c.strategy: c for c in (CurationConfig(), CurationConfig(0.7, 0.3, "aesthetic_first"), CurationConfig(0.3, 0.7, "people_first"), CurationConfig(strategy="top_heavy"))}


@dataclass(frozen=True)
class Settings:
    scan: ScanConfig = field(default_factory=ScanConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)
    emotional: EmotionalConfig = field(default_factory=EmotionalConfig)
    curation: CurationConfig = field(default_factory=CurationConfig)
