"""Settings of an analysis."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache
from zoneinfo import available_timezones

PROFILES = ("strict", "pragmatic", "forensics")


@lru_cache
def zone_named(name: str) -> str:
    """The zone that a name means: `local`, `localtime` and `system` are this host's, letter case is free, and a name that
    no zone has means UTC."""
    wanted = name.strip().lower()
    if wanted in ("local", "localtime", "system"):
        wanted = os.environ.get("TZ", "").lstrip(":").lower()
        if not wanted:
            link = os.path.realpath("/etc/localtime")
            wanted = link.split("zoneinfo/", 1)[1].lower() if "zoneinfo/" in link else "utc"
    return {z.lower(): z for z in available_timezones()}.get(wanted, "UTC")


@dataclass(frozen=True)
class Config:
    """threshold: least confidence of a timestamp (strict: of every field). log_tz: zone of times without an offset where
    naive_policy is local. run_ts: stands for now where a time has to be made up."""

    threshold: float = 0.3
    log_tz: str = "UTC"
    naive_policy: str = "local"
    reference_year: int | None = None
    encoding: str = "UTF-8"
    profile: str = "pragmatic"
    synthetic_timestamps: bool = False
    run_ts: str = "2024-01-01 00:00:00"
    context_lines: int = 5
    max_endpoints: int = 200
    max_group: int = 50
    bucket_seconds: int = 5

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ValueError(f"profile must be one of {PROFILES}")
        if self.naive_policy not in ("local", "utc"):
            raise ValueError("naive_policy must be local or utc")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie between 0 and 1")

    @property
    def zone(self) -> str:
        return "UTC" if self.naive_policy == "utc" else zone_named(self.log_tz)

    @property
    def allows_synthetic(self) -> bool:
        return self.synthetic_timestamps or self.profile == "forensics"
