"""Lineage-carrying operators and the forward graph."""

from wellspring.operators.graph import ForwardGraph, forward_graph
from wellspring.operators.lineage import Lineage

__all__ = ["ForwardGraph", "Lineage", "forward_graph"]
