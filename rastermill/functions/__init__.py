"""Part of rastermill."""
