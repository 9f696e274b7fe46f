"""Where a project's tables live, and a run's time stamp."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime


@dataclass(frozen=True)
class Paths:
    """Folders of a project under one root; any root that Spark reads will do."""

    root: str

    def __post_init__(self):
        object.__setattr__(self, "root", self.root.rstrip("/"))

    def raw(self, corpus: str) -> str:
        return f"{self.root}/{corpus}/raw"

    def sampled(self, corpus: str) -> str:
        return f"{self.root}/{corpus}/sampled"

    def clean(self, corpus: str) -> str:
        return f"{self.root}/{corpus}/clean"

    def tokens(self, corpus: str) -> str:
        return f"{self.root}/{corpus}/tokens"

    def counts(self, corpus: str, kind: str) -> str:
        return f"{self.root}/{corpus}/{kind}"

    def report(self, corpus: str, name: str) -> str:
        return f"{self.root}/{corpus}/{name}.json"


@contextmanager
def stamped(record: dict):
    """Fills in started (UTC), finished and elapsed seconds of a run's record."""
    began = time.monotonic()
    record["started"] = datetime.now(UTC).isoformat(timespec="seconds")
    try:
        yield record
    finally:
        record["finished"] = datetime.now(UTC).isoformat(timespec="seconds")
        record["elapsed"] = round(time.monotonic() - began, 3)
