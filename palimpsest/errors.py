"""Errors with stable codes; all are ``ValueError`` with the message ``[CODE] text``."""

from __future__ import annotations

# fixed values
CODES = (
    "INVALID_SCOPE", "DIMENSION_MISMATCH", "EMBEDDING_MODEL_MISMATCH", "NOT_FOUND", "REVISION_CONFLICT", "STORE_BUSY", "RECOVERY_REQUIRED",
    "CORRUPT_STORE", "ENCRYPTION_KEY_UNAVAILABLE", "POLICY_DENIED", "INVALID_FILTER", "INVALID_INPUT", "IO_ERROR", "DATABASE_ERROR",
)


class StoreError(ValueError):
    def __init__(self, code: str, text: str):
        assert code in CODES, code
        super().__init__(f"[{code}] {text}")
        self.code = code
