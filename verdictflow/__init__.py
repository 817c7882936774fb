"""verdictflow: a Spark-native verification analytics engine."""

__version__ = "0.1.0"
