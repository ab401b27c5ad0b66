"""Column types of the review tables."""

from __future__ import annotations

REVIEW_SCHEMA = "review_id string, product_name string, rating double, review_text string, review_date timestamp"
VIDEO_SCHEMA = (
    REVIEW_SCHEMA + ", source string, rating_estimated boolean, video_title string, video_url string, transcript_method string, "
    "video_id string, channel string, views bigint, timestamps array<struct<offset:int,seconds:double>>"
)
MENTION_COLUMNS = ("review_id", "product_name", "review_date", "rating", "sentiment", "sentiment_score", "theme", "polarity", "clause", "clause_score", "review_text")
