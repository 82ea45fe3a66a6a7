"""Spark-native two-modality retrieval analytics."""
