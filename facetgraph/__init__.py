"""facetgraph: structural relationship analytics as PySpark DataFrame programs."""
