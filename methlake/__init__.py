"""methlake: methylation signal analytics as PySpark jobs."""

__version__ = "0.1.0"
