"""callscope: a Spark-native engine for function-calling datasets."""

__version__ = "0.1.0"
