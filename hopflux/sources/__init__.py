"""Where edges come from: frames of several kinds, files, fixed networks and a generator."""

from hopflux.sources.frames import GraphImporter, edge_frame, read_edges, standardize_graph_dataframe
from hopflux.sources.generator import generate_random_network, grid_network
from hopflux.sources.networks import SiouxFalls, create_sf_network, sioux_falls, transit_example

__all__ = ["GraphImporter", "SiouxFalls", "create_sf_network", "edge_frame", "generate_random_network", "grid_network", "read_edges", "sioux_falls", "standardize_graph_dataframe", "transit_example"]
