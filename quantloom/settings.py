"""Settings from the environment, and logging as JSON lines."""

from __future__ import annotations

import functools
import json
import logging
import os
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

PREFIX = "QUANTLOOM_"
PROFILES = ("development", "staging", "production")


@dataclass(frozen=True)
class Settings:
    """Each field is read from ``QUANTLOOM_`` and its name in capitals."""

    profile: str = "development"
    log_level: str = "INFO"
    provider: str = "synthetic"
    vendor_user: str = ""
    vendor_key: str = ""
    contact: str = ""

    @classmethod
    def load(cls, environment: Mapping[str, str] | None = None) -> Settings:
        environment = os.environ if environment is None else environment
        found = cls(**{f.name: environment[PREFIX + f.name.upper()].strip() for f in fields(cls) if PREFIX + f.name.upper() in environment})
        if found.profile not in PROFILES:
            raise ValueError(f"unknown profile {found.profile!r}, not one of {', '.join(PROFILES)}")
        return found

    def require(self, *names: str) -> None:
        """An error that names all of ``names`` that are not set."""
        missing = [PREFIX + n.upper() for n in names if not getattr(self, n)]
        if missing:
            raise ValueError(f"not set: {', '.join(missing)}")

    def __repr__(self) -> str:
        """Without the key."""
        return f"Settings(profile={self.profile!r}, provider={self.provider!r}, vendor_user={self.vendor_user!r})"


class JsonLines(logging.Formatter):
    """A record and what it carries in ``extra={"fields": {...}}``, as one line."""

    def format(self, record: logging.LogRecord) -> str:
        said = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "event": record.getMessage(), **getattr(record, "fields", {})}
        if record.exc_info:
            said["error"] = self.formatException(record.exc_info)
        return json.dumps(said, default=str)


def get_logger(name: str, level: str | None = None) -> logging.Logger:
    logger = logging.getLogger(f"quantloom.{name}")
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(JsonLines())
        logger.addHandler(handler)
        logger.propagate = False
    logger.setLevel(level or Settings.load().log_level)
    return logger


def logged(function: Callable) -> Callable:
    """Log a call's end or failure, with its seconds."""

    @functools.wraps(function)
    def call(*args, **kwargs):
        logger, began = get_logger(function.__module__), time.perf_counter()
        about = {"function": function.__qualname__}
        try:
            result = function(*args, **kwargs)
        except Exception:
            logger.exception("call.failed", extra={"fields": about | {"seconds": round(time.perf_counter() - began, 4)}})
            raise
        logger.info("call.completed", extra={"fields": about | {"seconds": round(time.perf_counter() - began, 4)}})
        return result

    return call
