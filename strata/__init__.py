"""Voxel grids, labels, marks and contours as Spark tables."""
