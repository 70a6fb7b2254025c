"""Multiscale raster analytics on Spark: grids as DataFrames of cells, coarser levels as chained aggregations."""

from terrace.functions.reduce import METHODS
from terrace.operators.coarsen import coarsen, copy_level
from terrace.operators.pyramid import Pyramid, create_pyramid
from terrace.plans.layout import recommend_encoding
from terrace.plans.metadata import LayerHint, attach_metadata
from terrace.plans.raster import Coordinate, Raster, Variable

__all__ = ["METHODS", "Coordinate", "LayerHint", "Pyramid", "Raster", "Variable", "attach_metadata", "coarsen", "copy_level", "create_pyramid", "recommend_encoding"]
