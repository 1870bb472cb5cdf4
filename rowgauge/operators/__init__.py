"""Audit statistics: DataFrame in, DataFrame out."""
