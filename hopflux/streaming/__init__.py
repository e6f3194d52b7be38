"""Edge tables that grow: merge parallel edges of a stream as they arrive."""

from hopflux.streaming.edges import lightest_edges, snapshot

__all__ = ["lightest_edges", "snapshot"]
