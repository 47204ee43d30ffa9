"""A calibrated codec is frozen, so coding frames is a map without state: the same function serves tables and streams."""

from .codec import encode_stream

__all__ = ["encode_stream"]
