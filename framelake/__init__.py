"""framelake: analytics for two-level structure datasets, expressed as Spark plans."""

__version__ = "0.1.0"
