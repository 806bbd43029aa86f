"""A PySpark-native engine for hybrid keyframe retrieval and the data preparation behind it."""
