"""Inputs: driver tables and the views derived from them."""

from auditframe.sources.inputs import Inputs, VIEWS, oracle

__all__ = ["Inputs", "VIEWS", "oracle"]
