"""Streaming twins: merging observations as they arrive, and progress over events."""
