"""Spark-native preprocessing, quality control and data curation for sequencing reads."""

__version__ = "0.1.0"
