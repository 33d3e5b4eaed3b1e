"""Planted rows of farm fields from drone mosaics, as Spark jobs over tables."""
