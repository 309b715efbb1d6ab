"""Plan-time parameters of the preprocessing job."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from usageweave import constants as C


class TimezoneMode(Enum):
    """What to do with rows recorded in different time zones."""

    KEEP_SELECTED = 0
    CONVERT_TO_SELECTED = 1
    KEEP_PRIMARY = 2
    CONVERT_TO_PRIMARY = 3


@dataclass(frozen=True)
class StudyOptions:
    """Everything a run can be configured with.

    ``unit`` names the column that identifies one device log.  Units with more
    than ``hot_unit_rows`` rows are worked on in time slices of about
    ``slice_rows`` rows instead of in one task each.  ``unit_partitions`` is the
    number of partitions the other units are dealt into, by default Spark's
    ``spark.sql.shuffle.partitions``; adaptive execution can merge but not split
    them, so a large log needs about one for each 200 MB.
    """

    unit: str = "source_file"
    use_filter_list: bool = True
    use_codebook: bool = True
    minimum_usage_seconds: float = 0
    custom_engagement_seconds: int = 300
    usage_thresholds_hours: tuple[float, ...] = C.DEFAULT_THRESHOLDS
    gap_thresholds_hours: tuple[float, ...] = C.DEFAULT_THRESHOLDS
    timezone_mode: TimezoneMode = TimezoneMode.KEEP_SELECTED
    selected_timezone: str | None = None
    correct_duplicate_timestamps: bool = True
    normalise_usernames: bool = False
    same_app_stops: tuple[str, ...] = C.SAME_APP_STOPS
    other_app_stops: tuple[str, ...] = C.OTHER_APP_STOPS
    removed_types: tuple[str, ...] = C.REMOVABLE_TYPES
    plot_filtered_usage: bool = False
    plot_target_child_only: bool = False
    hot_unit_rows: int = 2_000_000
    slice_rows: int = 1_000_000
    unit_partitions: int = 0

    def __post_init__(self) -> None:
        unexpected = set(self.same_app_stops) - set(C.SAME_APP_STOPS)
        if unexpected:
            raise ValueError(f"not a same-app stop type: {sorted(unexpected)}")
        selected = (TimezoneMode.KEEP_SELECTED, TimezoneMode.CONVERT_TO_SELECTED)
        if self.timezone_mode in selected and self.selected_timezone == "":
            raise ValueError("selected_timezone must not be empty")

    @property
    def filtered_same_app_stops(self) -> tuple[str, ...]:
        """Filtered twins of the same-app stop types."""
        return tuple(C.FILTERED_TWIN[t] for t in self.same_app_stops)

    @property
    def filtered_other_app_stops(self) -> tuple[str, ...]:
        return self.other_app_stops

    @classmethod
    def minimal(cls, **overrides) -> StudyOptions:
        """Smallest stop rules, nothing removed: the picker's own preset."""
        preset = {
            "same_app_stops": (C.ACTIVITY_PAUSED,),
            "other_app_stops": (C.DEVICE_SHUTDOWN,),
            "removed_types": (),
        }
        return cls(**{**preset, **overrides})
