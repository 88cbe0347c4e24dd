"""Fetching of web pages on the executors.

Every address on the way is checked before anything is sent to it: https, a host that is allowed and public by all of its
addresses, and robots.txt. Redirects are followed by hand. What goes wrong with a page is its `failure`, never an exception.
"""

from __future__ import annotations

import hashlib
import re
import socket
import ssl
from collections.abc import Callable, Iterator
from http.client import HTTPException, HTTPSConnection
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.web import MAX_BYTES, MEDIA, all_public, host_and_port

# Fixed values.
MAX_REDIRECTS = 5
REDIRECTS = (301, 302, 303, 307, 308)
TIMEOUT = 20.0
#: Hosts whose robots.txt a task keeps.
HOSTS_KEPT = 5_000

Reply = tuple[int, dict[str, str], bytes]
Get = Callable[[str, str, dict[str, str]], Reply]
Resolve = Callable[[str], list[str]]


class Refused(Exception):
    """A rule that a page breaks."""


def addresses_of(host: str) -> list[str]:
    return sorted({str(found[4][0]) for found in socket.getaddrinfo(host, 443, proto=socket.IPPROTO_TCP)})


def over_https(url: str, address: str, headers: dict[str, str]) -> Reply:
    """One GET of url from this address, so that a second look-up cannot lead elsewhere; of the body a byte more than is allowed at most."""
    parts = urlsplit(url)
    host, port = parts.hostname or "", parts.port or 443
    link = HTTPSConnection(host, port, timeout=TIMEOUT)
    try:
        with socket.create_connection((address, port), TIMEOUT) as plain:
            link.sock = ssl.create_default_context().wrap_socket(plain, server_hostname=host)
            link.request("GET", parts.path + ("?" + parts.query if parts.query else ""), headers=headers)
            got = link.getresponse()
            return got.status, {k.lower(): v for k, v in got.getheaders()}, got.read(MAX_BYTES + 1)
    finally:
        link.close()


def normal(url: str) -> str:
    """As normalize_url; what that has no form for is refused."""
    found = re.match(r"(?i:https)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url)
    name, _, port = (found[1] if found else "").rpartition("@")[2].partition(":")
    host = name.lower().rstrip(".")
    if not found or not host or not re.fullmatch("[0-9]*", port):
        raise Refused("not_https")
    return f"https://{host}{':' + port if port not in ('', '443') else ''}{found[2] or '/'}{'?' + found[3] if found[3] else ''}"


class Visitor:
    """Fetches pages as one agent; the rules of a host are asked once."""

    def __init__(self, agent: str, get: Get, resolve: Resolve, allow_hosts: tuple[str, ...]):
        self.agent, self.get, self.resolve, self.allow_hosts = agent, get, resolve, allow_hosts
        self.rules: dict[str, RobotFileParser | bool] = {}

    def _ask(self, url: str) -> Reply:
        host = urlsplit(url).hostname or ""
        if host == "localhost" or host.endswith((".localhost", ".local")):
            raise Refused("local_host")
        if self.allow_hosts and host not in self.allow_hosts:
            raise Refused("host_not_allowed")
        addresses = self.resolve(host)
        if not all_public(addresses):
            raise Refused("private_address")
        return self.get(url, addresses[0], {"User-Agent": self.agent, "Accept": ", ".join(MEDIA), "Accept-Encoding": "identity"})

    def _allowed(self, url: str) -> bool:
        site = "/".join(url.split("/")[:3])
        if site not in self.rules:
            if len(self.rules) >= HOSTS_KEPT:
                self.rules.clear()
            status, _, body = self._ask(site + "/robots.txt")
            rules: RobotFileParser | bool = status not in (401, 403)
            if status < 400:
                rules = RobotFileParser()
                rules.parse(body.decode("utf-8", "replace").splitlines())
            self.rules[site] = rules
        known = self.rules[site]
        return known if isinstance(known, bool) else known.can_fetch(self.agent, url)

    def follow(self, url: str) -> tuple[str, Reply]:
        """The last address and its reply."""
        for _ in range(MAX_REDIRECTS + 1):
            url = normal(url)
            if not self._allowed(url):
                raise Refused("robots")
            reply = self._ask(url)
            if reply[0] not in REDIRECTS:
                return url, reply
            if not reply[1].get("location"):
                raise Refused("no_location")
            url = urljoin(url, reply[1]["location"])
        raise Refused("too_many_redirects")

    def page(self, url: str | None) -> dict:
        """A row of fetch_pages."""
        row = dict.fromkeys(_COLUMNS) | {"url": url}
        try:
            row["final_url"], (row["status"], headers, body) = self.follow(url or "")
        except Refused as rule:
            return row | {"failure": str(rule)}
        except (OSError, HTTPException, ValueError):  # name look-ups, connections, certificates, and replies that are none
            return row | {"failure": "request_failed"}
        row |= {"content_type": headers.get("content-type", ""), "etag": headers.get("etag") or None, "last_modified": headers.get("last-modified") or None}
        if len(body) > MAX_BYTES:
            return row | {"failure": "too_large"}
        named = re.search(r"(?i)charset=[\"']?([\w.:-]+)", row["content_type"])
        try:
            html = body.decode(named[1] if named else "utf-8", "replace")
        except LookupError:
            html = body.decode("utf-8", "replace")
        return row | {"html": html, "body_sha256": hashlib.sha256(body).hexdigest()}


_COLUMNS = ("url", "final_url", "status", "content_type", "etag", "last_modified", "html", "body_sha256", "failure")
_SCHEMA = ", ".join(f"{c} {'int' if c == 'status' else 'string'}" for c in _COLUMNS)


def fetch_pages(addresses: DataFrame, agent: str, url: str = "url", allow_hosts: tuple[str, ...] = (), lanes: int = 4, get: Get = over_https, resolve: Resolve = addresses_of) -> DataFrame:
    """A row for each row of addresses: url, final_url, status, content_type, etag, last_modified, html, body_sha256, failure.

    What read_pages takes. failure is null, or the rule that a page breaks, or request_failed; null addresses are no https.
    A host's pages are fetched by `lanes` tasks at most, one after the other in each: that many connections a host sees. A task
    holds one page at a time. An executor that is lost fetches its pages again, so write the result before it is used twice.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        visitor = Visitor(agent, get, resolve, allow_hosts)
        for f in frames:
            for one in f["url"]:
                yield pd.DataFrame([visitor.page(one)], columns=list(_COLUMNS)).astype({"status": "Int32"})

    rows = addresses.select(F.col(url).alias("url"))
    host, _ = host_and_port(F.col("url"))
    return rows.repartition(host, F.pmod(F.xxhash64("url"), F.lit(lanes))).mapInPandas(run, _SCHEMA)
