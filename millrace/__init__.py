"""Millrace: community-content search, matching, recommendation and data upkeep on Spark DataFrames."""
