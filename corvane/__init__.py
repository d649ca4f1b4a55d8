"""corvane: text retrieval and content analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
