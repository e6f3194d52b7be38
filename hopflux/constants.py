"""Fixed values of the model."""

import sys

#: Distance of an unreached vertex where infinities are not wanted: the largest double.
INF = sys.float_info.max
#: Bounds that frequencies are brought into; an infinite frequency means no waiting.
INF_FREQ = 1.0e20
MIN_FREQ = 1.0e-20
#: Smallest travel time of a transit edge.
MIN_TIME = 1.0e8 * MIN_FREQ
#: Predecessor of a root or unreached vertex in breadth-first trees.
UNREACHABLE = -9999
