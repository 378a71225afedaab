"""Scores and rules as column expressions.  Thresholds default to the product's values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later) / 86400.0


def trending(count: Column, sources: Column, frozen: Column, updated: Column, first: Column, now: Column) -> Column:
    """Article count decayed by age: 0 for one source with 5 or more articles; without a time, a twentieth of the count."""
    anchor = F.coalesce(frozen, updated, first)
    age = F.greatest(F.lit(0.0), days_between(now, anchor))
    return F.when((sources <= 1) & (count >= 5), 0.0).when(anchor.isNull(), count * 0.05).otherwise(count * F.greatest(F.lit(0.005), F.pow(F.lit(0.85), age)))


def blindspot_by_articles(state: Column, diaspora: Column, small: int = 6, minority: int = 20) -> Column:
    """'state_only', 'diaspora_only' or null: a side is missing, a lone voice in a small story, or below the minority share."""
    total = state + diaspora
    return (
        F.when(total == 0, None).when((diaspora > 0) & (state == 0), "diaspora_only").when((state > 0) & (diaspora == 0), "state_only")
        .when((total < small) & (state == 1) & (diaspora >= 2), "diaspora_only").when((total < small) & (diaspora == 1) & (state >= 2), "state_only")
        .when(state * 100 < minority * total, "diaspora_only").when(diaspora * 100 < minority * total, "state_only")
    )


def blindspot_by_shares(inside: Column, outside: Column, loud: int = 70, quiet: int = 30) -> Column:
    return F.when((inside >= loud) & (outside <= quiet), "state_only").when((outside >= loud) & (inside <= quiet), "diaspora_only")


def dispute(state: Column, diaspora: Column) -> Column:
    """How far two sides' framing words (arrays) differ, 0 to 1; 0.15 if a side has none."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda w: F.trim(w)), lambda w: w != ""))
    s, d = clean(state), clean(diaspora)
    distinct = 1 - F.size(F.array_intersect(s, d)) / F.size(F.array_union(s, d))
    depth = F.least(F.size(s), F.size(d), F.lit(3)) / 3.0
    return F.when((F.size(s) == 0) | (F.size(d) == 0), 0.15).otherwise(F.bround(F.least(F.lit(1.0), 0.35 + 0.55 * distinct * depth + 0.10 * depth), 2))


def update_kind(count: Column, score: Column, inside: Column, outside: Column, text_hash: Column, old_count: Column, old_score: Column, old_inside: Column, old_outside: Column, old_hash: Column) -> Column:
    """What changed since a snapshot: dispute by .2, coverage by 15 points, or 3 new articles and a new text."""
    none = lambda c: F.coalesce(c, F.lit(0))
    shift = F.greatest(F.abs(none(inside) - none(old_inside)), F.abs(none(outside) - none(old_outside)))
    return F.when(F.abs(score - old_score) >= 0.2, "dispute").when(shift >= 15, "coverage_shift").when((none(count) - none(old_count) >= 3) & text_hash.isNotNull() & ~text_hash.eqNullSafe(old_hash), "new_articles")


def hourly_kind(new: Column, inside_before: Column, outside_before: Column, inside_after: Column, outside_after: Column) -> Column:
    """Side flip, then a shift of 15 points or more, then a burst of two or more new articles."""
    flip = ((inside_before == 0) & (inside_after > 0) & (outside_before > 0)) | ((outside_before == 0) & (outside_after > 0) & (inside_before > 0))
    share = lambda a, b: F.when(a + b > 0, F.bround(a * 100.0 / (a + b))).otherwise(0)
    shift = F.abs(share(inside_after, outside_after) - share(inside_before, outside_before))
    return F.when(flip, "side_flip").when((inside_before + outside_before > 0) & (shift >= 15), "coverage_shift").when(new >= 2, "burst")


def trust(current: Column, flagged: Column, total: Column, median: Column) -> Column:
    """A source's trust after a review: up .05 when clean, down with a rate over three times the median."""
    rate = flagged / total
    lowered = F.greatest(F.lit(0.5), 1 - 2 * (rate - median))
    return F.bround(F.least(F.lit(1.0), F.when(flagged == 0, current + 0.05).when(rate > 3 * F.greatest(median, F.lit(0.01)), lowered).otherwise(current + 0.05)), 3)


def match_threshold(size: Column, age_days: Column, trust: Column) -> Column:
    """Least cosine for joining a story: by size and age, raised for little trusted sources."""
    base = F.when(size < 10, 0.45).when(age_days >= 5, 0.65).when(age_days > 2, 0.55).otherwise(0.40)
    return F.least(F.lit(0.95), base / F.greatest(trust, F.lit(0.5)))


def combined(machine: Column, people: Column) -> Column:
    """0.4 of the machine's score and 0.6 of the people's (1 to 5, made 0 to 1); either alone where the other is null."""
    human = (people - 1) / 4
    return F.when(machine.isNotNull() & human.isNotNull(), 0.4 * machine + 0.6 * human).otherwise(F.coalesce(machine, human))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def alignment_label(score: Column) -> Column:
    return F.when(score <= -0.6, "strong_left").when(score <= -0.2, "left").when(score < 0.2, "center").when(score < 0.6, "right").otherwise("strong_right")


def summary_cap(count: Column) -> Column:
    return F.when(count >= 60, 20).when(count >= 30, 16).otherwise(10)


def lifecycle(count: Column, last: Column, first: Column, frozen: Column, now: Column) -> Column:
    """active, then frozen (7 quiet days after a day of grace, or over 100 articles), archived (30 days), deleted (60 days and under 3 articles)."""
    quiet, born = days_between(now, last), days_between(now, first)
    return (
        F.when((quiet > 60) & (count < 3), "deleted").when(quiet > 30, "archived")
        .when(frozen.isNotNull() | (count > 100) | ((quiet > 7) & (born > 1)), "frozen").otherwise("active")
    )
