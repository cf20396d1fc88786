"""Operators of a training-data pipeline; `catalog` holds their checked queries."""
