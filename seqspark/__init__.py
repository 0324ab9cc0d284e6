"""Spark-native operators for nanopore direct-RNA sequencing tables."""
