"""Density profiles and the option checks that run on the driver."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import PROFILE


@dataclass(frozen=True)
class Profile:
    """How densely scenes are sampled, and how close two frames must be to be duplicates."""

    name: str
    scene_sample_interval: float
    dedup_hamming_threshold: int
    slide_dedup_hamming_threshold: int


#: Interval in seconds, Hamming threshold, Hamming threshold for slides.
HIGH = Profile("high", 3.0, 3, 1)
NORMAL = Profile("normal", 5.0, 5, 3)
LOW = Profile("low", 15.0, 8, 6)
PROFILES = {p.name: p for p in (HIGH, NORMAL, LOW)}

DETECTORS = ("content", "adaptive")


def density_name(value: str) -> str:
    """The density that a text names, whatever its case and margin."""
    name = value.strip().lower()
    if name not in PROFILES:
        raise ValueError(f"unknown density {value!r}: one of {', '.join(PROFILES)}")
    return name


def detector_name(value: str) -> str:
    """The scene detector that a text names."""
    name = value.strip().lower()
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {value!r}: one of {', '.join(DETECTORS)}")
    return name


def interval_seconds(value: float) -> float:
    if value < 0:
        raise ValueError("a sample interval is zero or more")
    return value


def chapter_numbers(value: str) -> set[int]:
    """``"0, 2,4"`` as {0, 2, 4}; blanks between commas are skipped."""
    out = set()
    for part in value.split(","):
        if part := part.strip():
            if not part.isascii() or not part.isdigit():
                raise ValueError(f"no chapter number: {part!r}")
            out.add(int(part))
    return out


def build_profiles(default: str, interval: float) -> dict[str, Profile]:
    """All profiles, the default one with the given interval in place of its own (that one alone, whichever it is)."""
    chosen = density_name(default)
    return PROFILES | {chosen: replace(PROFILES[chosen], scene_sample_interval=max(0.0, interval))}


def known(value: Column, density: Column) -> Column:
    """A value of a profile, joined from the left: raises where no profile has the row's density."""
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("unknown density: "), F.coalesce(density, F.lit("null"))))).otherwise(value)


def profile_rows(spark: SparkSession, profiles: dict[str, Profile]) -> DataFrame:
    """One row a profile: three rows, so broadcasting them is safe."""
    return spark.createDataFrame([(p.name, p.scene_sample_interval, p.dedup_hamming_threshold, p.slide_dedup_hamming_threshold) for p in profiles.values()], PROFILE)
