"""quillon: a Spark-native engine for building and evaluating retrieval-augmented question-answering data."""

__version__ = "0.1.0"
