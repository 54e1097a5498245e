"""Exceptions raised by the engine."""


class EngineError(Exception):
    """Base class of everything the engine raises on purpose."""


class InvalidQuery(EngineError, ValueError):
    """A filter text, name or query parameter is malformed."""


class StorageError(EngineError):
    """Stored data is missing, inconsistent or cannot be placed safely."""
