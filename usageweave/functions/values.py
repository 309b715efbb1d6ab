"""Value expressions: type names, flags, colours, label lists."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from usageweave import constants as C


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def canonical_type(raw: Column) -> Column:
    """Canonical interaction type; unknown spellings are kept."""
    return F.coalesce(literal_map(C.RAW_INTERACTION_NAMES)[raw], raw)


def event_priority(kind: Column, stop_types: Iterable[str]) -> Column:
    """Rank of a type among rows with one timestamp; 3 is an unknown type."""
    spelled = F.when(
        kind == "Screen Non-interactive", F.lit(C.SCREEN_NON_INTERACTIVE)
    ).otherwise(kind)
    return (
        F.when(spelled == C.ACTIVITY_RESUMED, 0)
        .when(spelled.isin(*stop_types), 2)
        .when(spelled.isin(*C.KNOWN_TYPES), 1)
        .otherwise(3)
    )


def same_app(left: Column, right: Column) -> Column:
    """Equal packages; a missing package equals nothing."""
    return F.coalesce(left == right, F.lit(False))


def _highest(value: Column, thresholds: Iterable[float], label: str) -> Column:
    expr = None
    for t in sorted(thresholds, reverse=True):
        text = F.lit(f">{t}-HR {label}")
        expr = F.when(value >= t, text) if expr is None else expr.when(value >= t, text)
    return expr


def usage_flags(
    gap_hours: Column,
    minutes: Column,
    gap_thresholds: Iterable[float],
    usage_thresholds: Iterable[float],
) -> Column:
    """Array of quality flags, the gap flag first."""
    gap = _highest(gap_hours, gap_thresholds or C.FALLBACK_THRESHOLDS, "TIME GAP")
    usage = _highest(
        minutes / 60, usage_thresholds or C.FALLBACK_THRESHOLDS, "APP USAGE"
    )
    return F.array_compact(F.array(gap, usage))


def category_colour(category: Column) -> Column:
    return F.coalesce(
        literal_map(C.CATEGORY_COLOURS)[category],
        F.lit(C.CATEGORY_COLOURS[C.UNCATEGORISED]),
    )


def stripped(text: Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def label_list(text: Column) -> Column:
    """Trimmed entries of a comma list."""
    return F.transform(F.split(text, ",", -1), lambda label: stripped(label))


def quoted(text: Column) -> Column:
    """Text in single quotes, or in double quotes when it holds a single one."""
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def is_tablet_package(package: Column) -> Column:
    """Package name contains one of the tablet vendor's; missing is no match."""
    escaped = "|".join(p.replace(".", r"\.") for p in C.TABLET_PACKAGES)
    return F.coalesce(package.rlike(escaped), F.lit(False))
