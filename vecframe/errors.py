"""Errors by kind, as subclasses of the built-in ones that callers already catch."""


class VectorError(Exception):
    """Any error of this package."""


class DimensionMismatch(VectorError, ValueError):
    pass


class InvalidConfig(VectorError, ValueError):
    pass


class InvalidFilter(VectorError, ValueError):
    pass


class DuplicateId(VectorError, KeyError):
    pass


class CollectionNotFound(VectorError, KeyError):
    pass


class CollectionExists(VectorError, KeyError):
    pass


class SnapshotNotFound(VectorError, KeyError):
    pass


class SnapshotExists(VectorError, KeyError):
    pass


class EmbedderMissing(VectorError, RuntimeError):
    pass
