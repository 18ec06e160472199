"""Classes and grades as CASE expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Angles, in degrees, below which two tables of sets agree, or agree in part.
GREEN, YELLOW = 20.0, 35.0


def consistency(angle: Column) -> Column:
    return F.when(angle < GREEN, "consistent").when(angle < YELLOW, "partial").otherwise("conflict")


def joint_tier(angle: Column) -> Column:
    return F.when(angle < GREEN, "joint").when(angle < YELLOW, "pair_only").otherwise("independent")


def traffic_light(angle: Column) -> Column:
    return F.when(angle < GREEN, "green").when(angle < YELLOW, "yellow").otherwise("red")


def quality_grade(rows: Column) -> Column:
    """Whether a log has enough rows: A from 50, B from 20, else F."""
    return F.when(rows >= 50, "A").when(rows >= 20, "B").otherwise("F")


def development_grade(percent: Column) -> Column:
    return F.when(percent >= 20, "strong").when(percent >= 10, "moderate").when(percent >= 5, "weak").otherwise("sporadic")


def anisotropy_tier(anisotropy: Column) -> Column:
    return F.when(anisotropy >= 0.5, "high").when(anisotropy >= 0.25, "middle").otherwise("low")


def scenario_class(angle: Column, names: tuple[str, str, str]) -> Column:
    """First name below 30 degrees, second below 60, else the third; null where there is no direction."""
    return F.when(angle.isNull(), F.lit("not applicable")).when(angle < 30, names[0]).when(angle < 60, names[1]).otherwise(names[2])


#: Grades from the best to the worst.
GRADES = ("suitable", "conditional", "unsuitable")


def overlap_grade(crit_lo: Column, crit_hi: Column, est_lo: Column, est_hi: Column) -> Column:
    """Suitable if the estimate lies below the critical band, unsuitable if above it, else conditional."""
    return F.when(est_hi < crit_lo, GRADES[0]).when(est_lo > crit_hi, GRADES[2]).otherwise(GRADES[1])


def penalized(grade: Column, escape: Column) -> Column:
    """One grade down where escape has priority `high`."""
    down = F.when(grade == GRADES[0], GRADES[1]).otherwise(GRADES[2])
    return F.when(escape.startswith("high"), down).otherwise(grade)


def bin_grade(value: Column, lo: Column, hi: Column) -> Column:
    return F.when(value < lo, GRADES[0]).when(value > hi, GRADES[2]).otherwise(GRADES[1])


def recommended_k(n_obs: Column, per_set: int = 11, least: int = 2, most: int = 12) -> Column:
    """Sets that so many observations can carry."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(n_obs / per_set).cast("int")))


def set_kappa(mean_angle: Column) -> Column:
    """Concentration from the mean angle to the center, in degrees; at most 100."""
    s = F.radians(F.greatest(mean_angle, F.lit(1.0)))
    return F.least(F.lit(100.0), 1 / (s * s + 0.01))
