"""vistaspark: PySpark-native grouping of image collections by viewpoint."""
