"""tidepanel: Spark-first analytics for entity-by-date panels."""

__version__ = "0.1.0"
