"""Structured Streaming: incremental ingest of landed monthly record pages."""

from resalelens.streaming.ingest import start_clean_ingest, start_month_group_counts, stream_records

__all__ = ["stream_records", "start_clean_ingest", "start_month_group_counts"]
