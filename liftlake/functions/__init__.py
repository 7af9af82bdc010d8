"""Scalar column helpers (built-in expressions only, no Python UDFs)."""

from liftlake.functions.exprs import *  # noqa: F401,F403
from liftlake.functions.exprs import __all__  # noqa: F401
