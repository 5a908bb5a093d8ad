"""Gneiss: property-graph and corpus analytics expressed as Spark plans."""
