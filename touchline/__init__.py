"""touchline: advertising analytics as lazy Spark DataFrame transformations."""

from touchline.params import Params

__all__ = ["Params"]
