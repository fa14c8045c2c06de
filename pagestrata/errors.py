"""The one error type raised for broken inputs and contracts."""

from __future__ import annotations


class AuditError(Exception):
    """An input or artifact broke its contract; ``code`` says which one."""

    def __init__(self, code: str, message: str, details: list | None = None):
        super().__init__(message)
        self.code = code
        self.message = message
        self.details = details or []


def error_record(error: BaseException) -> dict:
    """``{code, message}`` of any exception, with defaults for foreign ones."""
    return {
        "code": getattr(error, "code", None) or "UNEXPECTED_ERROR",
        "message": str(error) or "Unexpected failure.",
    }
