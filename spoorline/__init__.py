"""Spark-native static lineage engine: facts about ETL sources as DataFrames."""

__version__ = "0.1.0"
