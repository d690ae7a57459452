"""Spark-native analytics over block, payment, peer and metric relations."""
