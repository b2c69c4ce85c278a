"""Scalar functions of the dialect."""
from .scalar import ArityError, UnknownFunction, call, register

__all__ = ["ArityError", "UnknownFunction", "call", "register"]
