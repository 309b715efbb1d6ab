"""Device-usage log preprocessing as PySpark DataFrame operators."""

from usageweave.config import StudyOptions, TimezoneMode

__version__ = "0.1.0"
__all__ = ["StudyOptions", "TimezoneMode", "__version__"]
