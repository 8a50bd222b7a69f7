"""Fetching vendor payloads: a pace per host, retries that back off, and a pause for a host that keeps failing.

Runs on the driver, a request at a time; what it gets is landed as files and read by Spark.
"""

from __future__ import annotations

import gzip
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field


class FetchError(Exception):
    """A request that failed for good; status is the server's answer, if there was one."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


class HostPaused(FetchError):
    """The host failed too often in a row and is left alone for a while."""


@dataclass
class _Host:
    free_at: float = 0.0
    failures: int = 0
    paused_until: float = 0.0


@dataclass
class Fetcher:
    """Fetches URLs. pace: least seconds between requests to a host; clock, sleep and open_url can be replaced in tests."""

    agent: str = "pitspark"
    pace: dict[str, float] = field(default_factory=dict)
    attempts: int = 3
    first_wait: float = 1.0
    most_wait: float = 30.0
    pause_after: int = 5
    pause: float = 30.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    open_url: Callable = urllib.request.urlopen
    _hosts: dict[str, _Host] = field(default_factory=dict)

    def _enter(self, name: str) -> _Host:
        host = self._hosts.setdefault(name, _Host())
        now = self.clock()
        if now < host.paused_until:
            raise HostPaused(f"{name} is paused for {host.paused_until - now:.0f} s")
        if now < host.free_at:
            self.sleep(min(host.free_at - now, 2 * self.most_wait))
        return host

    def _leave(self, name: str, host: _Host, failed: bool, wait: float | None = None) -> None:
        host.failures = host.failures + 1 if failed else 0
        host.free_at = self.clock() + (self.pace.get(name, 0.0) if wait is None else wait)
        if host.failures >= self.pause_after:
            host.paused_until = self.clock() + self.pause

    def get(self, url: str, timeout: float = 30.0) -> bytes:
        """The body, unpacked. Answers 408, 429 and 5xx and broken connections are tried again; others raise at once."""
        name = urllib.parse.urlsplit(url).netloc
        request = urllib.request.Request(url, headers={"User-Agent": self.agent, "Accept-Encoding": "gzip, deflate"})
        failure = FetchError(f"{url}: no attempt made")
        for attempt in range(self.attempts):
            host, asked = self._enter(name), None
            try:
                with self.open_url(request, timeout=timeout) as answer:
                    body, packed = answer.read(), answer.headers.get("Content-Encoding") or ""
                self._leave(name, host, failed=False)
                return gzip.decompress(body) if "gzip" in packed else zlib.decompress(body) if "deflate" in packed else body
            except urllib.error.HTTPError as e:
                try:
                    asked = max(0.0, float(e.headers.get("Retry-After")))
                except (AttributeError, TypeError, ValueError):
                    asked = None  # no number of seconds
                self._leave(name, host, failed=True, wait=asked)
                failure = FetchError(f"{url}: status {e.code}", e.code)
                if e.code not in (408, 429) and e.code < 500:
                    raise failure from e
            except OSError as e:
                self._leave(name, host, failed=True)
                failure = FetchError(f"{url}: {e}")
            if attempt + 1 < self.attempts:
                wait = min(self.most_wait, self.first_wait * 2**attempt)
                self.sleep(min(asked, self.most_wait) if asked is not None else random.uniform(wait / 2, wait))
        raise failure

    def json(self, url: str, timeout: float = 30.0):
        return json.loads(self.get(url, timeout))
