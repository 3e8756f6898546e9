"""Segmentation scoring, curation and voxel analytics as Spark DataFrame operators."""
