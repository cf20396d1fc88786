"""Time-series analytics as Spark DataFrame operators."""

from tidewell.frames import Shape, validate_multits
from tidewell.session import get_session

__all__ = ["Shape", "get_session", "validate_multits"]
