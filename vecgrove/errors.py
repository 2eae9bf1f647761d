"""Errors carry a stable kind and perhaps an input position, and never the data they are about."""

from __future__ import annotations

# The kinds.  What is said of each is our own.
MESSAGES = {
    "IndexBuilding": "the index has no committed version yet",
    "BulkBuildSuperseded": "another runner, or an abort, has ended this bulk job",
    "BulkBuildBusy": "the bulk job is in the wrong stage, or another runner holds it",
    "InvalidArgument": "invalid argument",
    "IndexAlreadyExists": "an index of this name has another configuration",
    "IndexNotFound": "no index of this name",
    "IndexDropping": "this index is going away",
    "RecordAlreadyExists": "a record of this id is there already",
    "UnsupportedFormat": "written in a format that this version doesn't read",
    "Unsupported": "not possible here",
    "TransactionTooLarge": "too much for one commit",
    "LimitExceeded": "a stated limit doesn't allow this",
    "ContentionExhausted": "other writers were first every time",
    "RetryableAbort": "given up before the commit; may be tried again",
    "CommitOutcomeUnknown": "can't tell whether the commit took place",
    "IdExhausted": "no free partition numbers",
    "DeadlineExceeded": "out of time",
    "Cancelled": "stopped by its caller",
    "RuntimeClosed": "the runtime is shut down",
    "Backend": "storage failed",
    "Other": "failed for an unknown reason",
    "Corruption": "stored tables contradict each other",
}


class IndexError_(Exception):
    """An engine error; ``detail`` is for the raising code's tests and is not rendered."""

    def __init__(self, kind: str, position: int | None = None, detail: str = ""):
        self.kind, self.position, self.detail = kind, position, detail
        super().__init__(MESSAGES[kind] + ("" if position is None else f" at position {position}"))


def invalid(detail: str, position: int | None = None) -> IndexError_:
    return IndexError_("InvalidArgument", position, detail)


def require(condition: bool, detail: str, kind: str = "InvalidArgument") -> None:
    if not condition:
        raise IndexError_(kind, None, detail)
