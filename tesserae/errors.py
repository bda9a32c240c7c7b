"""One exception class; its code says what kind of failure it is."""

from __future__ import annotations

#: The codes an error may have.
CODES = (
    "IO", "NOT_FOUND", "NOT_A_DATABASE", "UNSUPPORTED_FORMAT_VERSION", "CORRUPTED", "INVALID_ARGUMENT", "CLOSED", "BUSY", "SYNC_FAILED", "KEY_REQUIRED",
    "WRONG_KEY", "UNSUPPORTED_FILE_SYSTEM", "SCHEMA_MISMATCH", "SCHEMA_TOO_NEW", "DUPLICATE_KEY", "INVALID_QUERY", "MIGRATION_FAILED", "READ_ONLY", "INTERNAL",
)


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        assert code in CODES, code
        super().__init__(message)
        self.code = code


def invalid_query(message: str) -> EngineError:
    return EngineError("INVALID_QUERY", message)


def invalid_argument(message: str) -> EngineError:
    return EngineError("INVALID_ARGUMENT", message)
