"""Spark-native analytics over feature catalogues, raster tiles, image chips and latent vectors."""
