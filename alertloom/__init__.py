"""Detection analytics for security telemetry as Spark DataFrame operators."""

from alertloom.session import build_session

__all__ = ["build_session"]
