"""corpusweave: a Spark-native code-corpus index, hybrid vector + graph
retriever, and change/run analytics, written with DataFrames."""

__version__ = "0.1.0"
