"""Spark jobs for point clouds of trees, structure models built from them, and large text corpora."""
