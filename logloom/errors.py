"""Errors raised before any job starts."""


class InvalidRequest(ValueError):
    """An argument of an operator is missing or malformed."""


class StoreFailed(RuntimeError):
    """Accepted entries could not be stored; none of them became visible."""


class ReadFailed(RuntimeError):
    """Stored rows could not be read; asking again may help."""
