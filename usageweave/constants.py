"""Fixed vocabulary of device-usage logs.

Everything here is plain data: the spellings and numbers that results have to
agree on.  No logic lives in this module.
"""

from __future__ import annotations

# --- fixed values: canonical interaction types -----------------------------
ACTIVITY_RESUMED = "Activity Resumed"
ACTIVITY_PAUSED = "Activity Paused"
ACTIVITY_STOPPED = "Activity Stopped"
ACTIVITY_DESTROYED = "Activity Destroyed"
APP_USAGE = "App Usage"
END_OF_USAGE_MISSING = "End of Usage Missing"
FILTERED_APP_RESUMED = "Filtered App Resumed"
FILTERED_APP_PAUSED = "Filtered App Paused"
FILTERED_APP_STOPPED = "Filtered App Stopped"
FILTERED_APP_DESTROYED = "Filtered App Destroyed"
FILTERED_APP_USAGE = "Filtered App Usage"
SCREEN_NON_INTERACTIVE = "Screen Non-Interactive"
KEYGUARD_SHOWN = "Keyguard Shown"
DEVICE_SHUTDOWN = "Device Shutdown"
DEVICE_STARTUP = "Device Startup"
USER_STOPPED = "User Stopped"

# --- fixed values: raw spelling -> canonical interaction type --------------
RAW_INTERACTION_NAMES = {
    "Instance of Usage for an App": "App Usage",
    "Activity Resumed for a Filtered App": "Filtered App Resumed",
    "Activity Paused for a Filtered App": "Filtered App Paused",
    "Instance of Usage for a Filtered App": "Filtered App Usage",
    "Missing End of Usage after an App Starts Being Used": "End of Usage Missing",
    "Unknown importance: 1": "Activity Resumed",
    "Unknown importance: 2": "Activity Paused",
    "Unknown importance: 3": "End of Day",
    "Unknown importance: 4": "Continue Previous Day",
    "Unknown importance: 5": "Configuration Change",
    "Unknown importance: 6": "System Interaction",
    "Unknown importance: 7": "User Interaction",
    "Unknown importance: 8": "Shortcut Invocation",
    "Unknown importance: 9": "Chooser Action",
    "Unknown importance: 10": "Notification Seen",
    "Unknown importance: 11": "Standby Bucket Changed",
    "Unknown importance: 12": "Notification Interruption",
    "Unknown importance: 13": "Slice Pinned Priv",
    "Unknown importance: 14": "Slice Pinned App",
    "Unknown importance: 15": "Screen Interactive",
    "Unknown importance: 16": "Screen Non-Interactive",
    "Unknown importance: 17": "Keyguard Shown",
    "Unknown importance: 18": "Keyguard Hidden",
    "Unknown importance: 19": "Foreground Service Start",
    "Unknown importance: 20": "Foreground Service Stop",
    "Unknown importance: 21": "Continuing Foreground Service",
    "Unknown importance: 22": "Rollover Foreground Service",
    "Unknown importance: 23": "Activity Stopped",
    "Unknown importance: 24": "Activity Destroyed",
    "Unknown importance: 25": "Flush to Disk",
    "Unknown importance: 26": "Device Shutdown",
    "Unknown importance: 27": "Device Startup",
    "Unknown importance: 28": "User Unlocked",
    "Unknown importance: 29": "User Stopped",
    "Unknown importance: 30": "Locus ID Set",
    "Unknown importance: 31": "App Component Used",
    "Move to Foreground": "Activity Resumed",
    "Move to Background": "Activity Paused",
}

# Canonical types that no raw spelling maps to but that are still known.
EXTRA_KNOWN_TYPES = (
    "App Launch",
    "Notification Received",
    "Notification Removed",
    "Device Screen Off",
    "Screen Interactive/Keyguard Shown",
    "Screen Non-Interactive/Keyguard Hidden",
    "Filtered App Stopped",
    "Filtered App Destroyed",
    "Non-Target Child App Usage",
)

MAPPED_TYPES = tuple(sorted(set(RAW_INTERACTION_NAMES.values())))
KNOWN_TYPES = tuple(sorted({*MAPPED_TYPES, *EXTRA_KNOWN_TYPES}))

# --- fixed values: stop rules ----------------------------------------------
SAME_APP_STOPS = (
    "Activity Paused",
    "Activity Resumed",
    "Activity Stopped",
    "Activity Destroyed",
)
OTHER_APP_STOPS = (
    "Activity Resumed",
    "Screen Non-Interactive",
    "Keyguard Shown",
    "Activity Destroyed",
    "Device Shutdown",
    "User Stopped",
    "Filtered App Resumed",
    "Filtered App Usage",
)
FILTERED_TWIN = {
    "Activity Resumed": "Filtered App Resumed",
    "Activity Paused": "Filtered App Paused",
    "Activity Stopped": "Filtered App Stopped",
    "Activity Destroyed": "Filtered App Destroyed",
}
# Every mapped type may be removed except the ones that define a usage.
NOT_REMOVABLE = (
    "App Usage",
    "Filtered App Resumed",
    "Filtered App Paused",
    "Activity Resumed",
    "Activity Paused",
)
REMOVABLE_TYPES = tuple(t for t in MAPPED_TYPES if t not in NOT_REMOVABLE)

# --- fixed values: device models -------------------------------------------
TABLET_PACKAGES = (
    "com.amazon.redstone",
    "com.amazon.firelauncher",
    "com.amazon.imp",
    "com.amazon.alta.h2clientservice",
    "com.amazon.media.session.monitor",
)
TABLET_MODEL = "Amazon Fire"
PHONE_MODEL = "Android"

# --- fixed values: plot colours --------------------------------------------
CATEGORY_COLOURS = {
    "Games": "#e6194b",
    "Video Players (e.g. YouTube)": "#4363d8",
    "Social & Communication": "#fabed4",
    "Entertainment": "#f58231",
    "Lifestyle": "#42d4f4",
    "Productivity & Business": "#aaffc3",
    "Health": "#469990",
    "Education": "#800000",
    "Travel & Local": "#9a6324",
    "News & Magazines": "#dcbeff",
    "Photography": "yellow",
    "Uncategorised": "#000000",
}
MARKER_COLOURS = {
    "Device Shutdown": "red",
    "Device Startup": "green",
    "End of Usage Missing": "gray",
}
GAP_COLOUR = "#FF00FF"

# --- fixed values: text and numbers ----------------------------------------
TARGET_CHILD = "Target Child"
UNKNOWN = "Unknown"
UNCATEGORISED = "Uncategorised"
MIN_TIMESTAMP_LENGTH = 25
LONG_USAGE_MICROS = 12 * 3600 * 1_000_000
DEFAULT_THRESHOLDS = (1, 6, 12, 24)
FALLBACK_THRESHOLDS = (3, 6, 12, 24)
RAW_FILE_PATTERN = r"[\s\S]*.csv"
RAW_FILE_IGNORE = ("Survey", "Archive", "Do Not Use")
FILES_IGNORE = ("Preprocessed",)
OUTPUT_SUFFIX = " Automatically Preprocessed"
DATETIME_FORMAT = "MM-dd-yyyy HH:mm:ss"
# Cell texts that the usual CSV readers of these logs take as missing.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- working columns added while a log is processed ------------------------
SEQ = "seq"
SLICE = "unit_slice"
EVENT_US = "event_us"
RAW_US = "raw_us"
