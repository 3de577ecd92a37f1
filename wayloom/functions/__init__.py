"""Column expressions: geometry, hexagon binning, road names, text."""
