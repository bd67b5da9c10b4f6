"""One error type with stable codes."""

from __future__ import annotations

# The codes that faces print.
CODES = (
    "CONFIG_INVALID", "ADAPTER_PARSE_FAILURE", "ADAPTER_BIND_FAILURE", "CANDIDATE_NOT_FOUND",
    "INPUT_UNREADABLE", "SNAPSHOT_INVALID", "RE_EXPORT_DEPTH_EXCEEDED",
)


class KeelsonError(Exception):
    def __init__(self, code: str, reason: str, **where):
        if code not in CODES:
            raise ValueError(code)
        self.code, self.reason, self.where = code, reason, where
        place = ", ".join(f"{k} {v}" for k, v in where.items() if v is not None)
        super().__init__(f"{code}: {reason}" + (f" ({place})" if place else ""))
