"""Streaming-vocabulary, embedding and training-data engine on Spark DataFrames."""
