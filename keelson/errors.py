"""Errors of the engine; every one is raised before a job starts where that is possible."""


class KeelsonError(Exception):
    """Base of all errors raised here."""


class InvalidRequest(KeelsonError):
    """A request or a literal that doesn't fit the schema."""


class InvalidData(KeelsonError):
    """Input data that breaks its schema."""


class ConflictError(KeelsonError):
    """A state that forbids the operation (a held lock, an existing target, an empty result)."""


class NotFound(KeelsonError):
    """A bucket, generation, row or accelerator that isn't there."""


class LimitExceeded(KeelsonError):
    """A query that would examine more rows, or run longer, than it may."""
