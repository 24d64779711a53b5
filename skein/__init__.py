"""skein: a Spark-native engine for conversation histories of coding assistants."""

__version__ = "0.1.0"
