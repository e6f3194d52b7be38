"""Graph operators over canonical edge frames: (tail, head), (tail, head, weight) or (edge_idx, tail, head, trav_time, freq)."""
