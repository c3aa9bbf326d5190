"""rillgraph: event detection over text streams, expressed as Spark plans."""

__version__ = "0.1.0"
