"""DataFrame operators: catalogue, raster, sampling, statistics, evaluation, embedding losses, learning and graphs."""
