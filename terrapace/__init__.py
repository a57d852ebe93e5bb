"""Terrapace: 3D mobility and accessibility analytics as Spark DataFrame programs."""
