"""All registered queries; importing this package fills the registry."""

from lamina.catalog import blends, edges, rasters, saved_views, scalars, tiling, trees, visibility  # noqa: F401
from lamina.catalog.registry import ORACLES, QUERIES  # noqa: F401
