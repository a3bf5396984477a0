"""Search, graphs, indexes and their measures."""
