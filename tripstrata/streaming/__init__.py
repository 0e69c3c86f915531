"""Streaming of the segmentation engine."""
