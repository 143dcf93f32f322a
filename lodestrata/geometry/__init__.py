"""Planar geometry: rings, overlay areas, coordinate systems."""
