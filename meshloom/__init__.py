"""Spark-first analytics for 3D point clouds and the meshes derived from them."""
