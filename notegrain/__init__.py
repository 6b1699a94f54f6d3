"""notegrain: PySpark-native annotation, conversion and evaluation of clinical text."""
