"""Column names, types and label constants shared by all modules."""

from __future__ import annotations

POSITIVE, NEUTRAL, NEGATIVE = "Positive", "Neutral", "Negative"
# Alphabetical class order, as cross tables and confusion matrices list it.
SENTIMENTS = (NEGATIVE, NEUTRAL, POSITIVE)
NOT_PROCESSED = "Not Processed"
NOT_AVAILABLE = "Not Available"
NO_PREDICTION = (NOT_PROCESSED, NOT_AVAILABLE)

WEEKDAYS = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
)

# raw dump column -> column used here, with its type
RAW_COLUMNS = {
    "reviewId": ("review_id", "string"),
    "content": ("content", "string"),
    "score": ("score", "int"),
    "at": ("review_ts", "timestamp_ntz"),
    "repliedAt": ("replied_at", "timestamp_ntz"),
    "replyContent": ("reply_content", "string"),
    "appVersion": ("app_version", "string"),
}

TIMESTAMP_FORMAT = "M/d/yyyy H:mm"
