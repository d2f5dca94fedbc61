"""Streaming forms of the cohort operators (the reports themselves are batch)."""

from lastmile.streaming.cohorts import adopter_stream, first_use_stream, read_fulfilment_changes, start

__all__ = ["adopter_stream", "first_use_stream", "read_fulfilment_changes", "start"]
