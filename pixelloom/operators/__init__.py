"""Image operators: ``pixels`` for exploded images as Catalyst plans, ``raster`` for packed ones in arrays."""
