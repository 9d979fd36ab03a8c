"""Spatiotemporal data cubes on Spark: a lazy algebra over regular grids of time, y and x."""

from .cube import Cube
from .grid import Grid, View, cube_view
from .timeaxis import DateTime, Duration, Unit

__all__ = ["Cube", "DateTime", "Duration", "Grid", "Unit", "View", "cube_view"]
