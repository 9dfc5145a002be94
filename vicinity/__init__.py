"""Exact fixed-radius neighbour graphs of dense float vectors on Spark."""

from .operators.graph import NeighborGraph
from .operators.points import PointSet

__all__ = ["NeighborGraph", "PointSet"]
