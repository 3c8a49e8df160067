"""The plans as streams, and the forward graph with keyed state and event-time timers."""

from wellspring.streaming.frames import frame_stream
from wellspring.streaming.graph import graph_stream, prepare
from wellspring.streaming.latency import LatencyLog, arriving, latency_series, observed, run_logged
from wellspring.streaming.run import delivered, drain, staged, started, write_batches
from wellspring.streaming.standard import standard_graph_stream

__all__ = ["LatencyLog", "arriving", "delivered", "drain", "frame_stream", "graph_stream", "latency_series", "observed", "prepare", "run_logged", "staged", "standard_graph_stream", "started", "write_batches"]
