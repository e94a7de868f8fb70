"""Spark-native multimodal retrieval, clustering and corpus-preparation engine."""
