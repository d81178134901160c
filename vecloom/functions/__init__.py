"""Constants, batch kernels and column expressions of the vector codes."""

from .space import Space

__all__ = ["Space"]
