"""braidlake: a PySpark-native engine for question answering over text corpora."""

__version__ = "0.1.0"
