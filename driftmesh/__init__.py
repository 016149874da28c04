"""driftmesh: Spark-first analytics for objects that move together."""

__version__ = "0.1.0"
