"""Operators: DataFrame in, DataFrame out, lazily composed; each partitions by series_id."""
