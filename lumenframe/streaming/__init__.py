"""The same plans over Structured Streaming."""

from .queries import StreamQuery, stream_bucket_counts

__all__ = ["StreamQuery", "stream_bucket_counts"]
