"""Jobs on finished tables and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from usageweave.config import StudyOptions
from usageweave.constants import UNCATEGORISED
from usageweave.operators import timeline
from usageweave.operators.enrich import (
    category_distribution,
    enrich_codebook,
    map_categories,
)


def plot_tables(
    finished: DataFrame, codebook: DataFrame | None, options: StudyOptions, unit: str
) -> dict[str, DataFrame]:
    """Bars, markers, date spine and gap bars for every unit at once.

    ``finished`` is a typed finished table (see ``finished_types``).
    """
    bounds = timeline.date_bounds(finished, unit)
    usage = timeline.select_plot_usage(finished, options)
    table = codebook if options.use_codebook else None
    usage = enrich_codebook(usage, table, missing=UNCATEGORISED)
    return {
        "usage": timeline.daily_usage_segments(usage, bounds, unit),
        "markers": timeline.event_markers(finished),
        "dates": timeline.date_spine(finished, unit),
        "gaps": timeline.gap_segments(finished, bounds, unit),
    }


def categorise(
    finished: DataFrame, codebook: DataFrame, top: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Finished rows with categories, and the most frequent categories."""
    mapped = map_categories(finished, codebook)
    return mapped, category_distribution(mapped, top)
