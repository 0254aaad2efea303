"""Spark-native analytics over ordered capture streams and the documents recovered from them."""
