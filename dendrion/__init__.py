"""Spark-native analytics over collections of skeleton graphs and triangle meshes."""
