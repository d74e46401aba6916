"""Connected components."""

from skein.operators.components import components

__all__ = ["components"]
