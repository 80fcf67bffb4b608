"""HTTPS reads with retries, polite spacing and an injectable transport; picklable, so tasks can fetch."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

#: (url, headers) -> (status, body)
Transport = Callable[[str, Mapping[str, str]], tuple[int, bytes]]

# What is retried, how often and how long.
RETRIED = (429, 500, 502, 503, 504)
ATTEMPTS, BACKOFF_S, TIMEOUT_S = 3, 0.5, 30


class FeedError(RuntimeError):
    def __init__(self, status: int, body: bytes = b""):
        super().__init__(f"feed answered {status}: {body[:300].decode(errors='replace')}")
        self.status = status


class AuthError(FeedError):
    """The feed doesn't accept the login; never tried again and never skipped."""


# Statuses that mean a refused login.
REFUSED = (401, 403)


def over_network(url: str, headers: Mapping[str, str]) -> tuple[int, bytes]:
    if urllib.parse.urlsplit(url).scheme != "https":
        raise FeedError(0, f"only https is read, not {url}".encode())
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers)), timeout=TIMEOUT_S) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


@dataclass
class Feed:
    """One feed: its headers, how long to wait between requests, and what carries them.

    The clock is this object's own; ``sources.bodies`` keeps all requests to a host in one task, which has one copy of it.
    """

    headers: dict[str, str] = field(default_factory=dict)
    spacing_s: float = 0.0
    transport: Transport = over_network
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    last: float | None = None

    @classmethod
    def with_login(cls, user: str, key: str, **options) -> Feed:
        token = base64.b64encode(f"{user}:{key}".encode()).decode()
        return cls(headers={"Authorization": f"Basic {token}", "Accept": "application/json"}, **options)

    def read(self, url: str, parameters: Mapping[str, object] | None = None) -> bytes:
        """The body of an answer 200; list parameters are joined by commas. Others raise, some after retries."""
        if parameters:
            flat = {k: ",".join(map(str, v)) if isinstance(v, list | tuple) else v for k, v in parameters.items()}
            url = f"{url}?{urllib.parse.urlencode(flat)}"
        rest = 0.0 if self.last is None else self.spacing_s - (self.clock() - self.last)
        if rest > 0:
            self.sleep(rest)
        for attempt in range(ATTEMPTS):
            self.last = self.clock()
            status, body = self.transport(url, self.headers)
            if status == 200:
                return body
            if status in REFUSED:
                raise AuthError(status, body)
            if status not in RETRIED or attempt == ATTEMPTS - 1:
                raise FeedError(status, body)
            self.sleep(max(BACKOFF_S * 2**attempt, self.spacing_s))
        raise AssertionError("unreachable")

    def read_json(self, url: str, parameters: Mapping[str, object] | None = None) -> object:
        return json.loads(self.read(url, parameters))
