"""graphsift: property-graph schema discovery and RDF publishing on Spark."""

__version__ = "0.1.0"
