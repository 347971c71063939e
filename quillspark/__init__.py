"""A PySpark-native engine for natural-language request data and training corpora."""
