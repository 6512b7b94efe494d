"""Orrery: a PySpark-native analytics engine for multi-channel test data."""

__version__ = "0.2.0"


def __getattr__(name: str):
    """Session and Evidence, imported where they are asked for."""
    if name in ("Session", "Evidence"):
        from . import session

        return getattr(session, name)
    raise AttributeError(name)
