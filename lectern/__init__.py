"""Lectern: a Spark-native query and text-processing library for book collections."""
