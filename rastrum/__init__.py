"""rastrum: raster, codec and information-hiding analytics as relational plans on Spark."""

__version__ = "0.1.0"
