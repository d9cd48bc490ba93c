"""framelake: a Spark-native engine for large stacks of imaging frames."""

__version__ = "0.1.0"
