"""Transcript-corpus analytics on Spark: DataFrame in, DataFrame out."""
