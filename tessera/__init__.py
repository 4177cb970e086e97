"""Spark-native analytics engine: payment-risk pipeline, reports and graph operators."""
