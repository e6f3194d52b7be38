"""Shortest paths, breadth-first trees and transit assignment on Spark."""

import sys

from pyspark import cloudpickle

from hopflux.api import BFS, BellmanFord, Dijkstra, HyperpathGenerating
from hopflux.constants import INF, INF_FREQ, MIN_FREQ, MIN_TIME

# Functions of this package travel to the executors with the tasks: a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
__all__ = ["BFS", "INF", "INF_FREQ", "MIN_FREQ", "MIN_TIME", "BellmanFord", "Dijkstra", "HyperpathGenerating"]
