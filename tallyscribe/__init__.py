"""Annotated-text analytics on Spark: posts, rater labels, agreement, features, models, daily series."""
