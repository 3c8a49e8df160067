"""Inputs: text files of the four workloads, repeated inputs, and generated ones."""

from wellspring.sources.files import ANNOTATION, CLOUD, LINEAR_ROAD, SMART_GRID, annotations, cloud_vehicles, frames, linear_road, repeated, smart_grid, split_by
from wellspring.sources.generators import smart_grid_readings, synthetic_lineage, synthetic_overlap, synthetic_sources

__all__ = ["ANNOTATION", "CLOUD", "LINEAR_ROAD", "SMART_GRID", "annotations", "cloud_vehicles", "frames", "linear_road", "repeated", "smart_grid", "smart_grid_readings", "split_by", "synthetic_lineage", "synthetic_overlap", "synthetic_sources"]
