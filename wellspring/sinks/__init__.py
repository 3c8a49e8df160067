"""Outputs: lineage and graphs as text lines, JSON commands and tables, and the delivery store."""

from wellspring.sinks.encoders import Encoder, backward_lines, command_lines, graph_tables, jdbc, lines, noop, plain_lines, timestamped_lines
from wellspring.sinks.store import DeliveryStore

__all__ = ["DeliveryStore", "Encoder", "backward_lines", "command_lines", "graph_tables", "jdbc", "lines", "noop", "plain_lines", "timestamped_lines"]
