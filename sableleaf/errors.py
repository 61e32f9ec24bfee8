"""Errors that the engine raises."""


class StoreError(Exception):
    """Base of all errors of the engine."""


class NotFound(StoreError):
    """No document, file or trash entry of that name."""


class InvalidArgument(StoreError):
    """An argument that the operation can't take."""


class IndexError_(StoreError):
    """A layout that wasn't created, or that can't be."""


class SerializationError(StoreError):
    """A value that isn't JSON."""


class Locked(StoreError):
    """The folder is locked or read-only."""


class Conflict(StoreError):
    """Another writer committed first."""
