"""Fetched web pages, by a crawler or by fetch.fetch_pages: address rules, policies, and raw documents."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from quarry.sources.html import extract_html

MAX_BYTES = 5_000_000
MEDIA = ("text/html", "application/xhtml+xml")
_ADDRESS = r"^(?i:https)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_and_port(url: Column) -> tuple[Column, Column]:
    authority = F.regexp_replace(F.regexp_extract(url, _ADDRESS, 1), "^.*@", "")
    host = F.rtrim(F.lower(F.regexp_replace(authority, ":[0-9]*$", "")), F.lit("."))
    return host, F.regexp_extract(authority, ":([0-9]+)$", 1)


def normalize_url(url: Column) -> Column:
    """https only (else null): lower-case host without a last dot, no port 443, at least / as path, the query, no fragment."""
    host, port = host_and_port(url)
    path = F.regexp_extract(url, _ADDRESS, 2)
    query = F.regexp_extract(url, _ADDRESS, 3)
    out = F.concat(F.lit("https://"), host, F.when(port.isin("", "443"), "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query))
    return F.when(url.rlike(_ADDRESS) & (host != ""), out)


def local_host(url: Column) -> Column:
    host, _ = host_and_port(url)
    return (host == "localhost") | host.endswith(".localhost") | host.endswith(".local")


def policy(url: Column, html: Column, status: Column | None = None, content_type: Column | None = None, allow_hosts: tuple[str, ...] = ()) -> Column:
    """What the rules say of a fetched page: ok, or the first rule it breaks."""
    host, _ = host_and_port(url)
    out = F.when(normalize_url(url).isNull(), "not_https").when(local_host(url), "local_host")
    if allow_hosts:
        out = out.when(~host.isin(*allow_hosts), "host_not_allowed")
    if status is not None:
        out = out.when(status >= 400, "http_error")
    if content_type is not None:
        kind = F.lower(F.substring_index(content_type, ";", 1))
        out = out.when((kind != "") & ~kind.isin(*MEDIA), "unsupported")
    return out.when(F.octet_length(html.cast("binary")) > MAX_BYTES, "too_large").otherwise("ok")


def all_public(addresses: list[str]) -> bool:
    """Whether there are addresses and all are public."""
    try:
        each = [ipaddress.ip_address(a.strip()) for a in addresses]
    except ValueError:
        return False
    return bool(each) and not any(a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified for a in each)


@F.pandas_udf(BooleanType())
def public_address(addresses: pd.Series) -> pd.Series:
    """Whether all of a host's comma-separated addresses are public; a host without any is not."""
    return addresses.map(lambda value: isinstance(value, str) and all_public(value.split(",")))


def robots(agent: str):
    """A function of (status of robots.txt, its text, url): allowed or quarantined."""

    @F.pandas_udf("string")
    def decide(status: pd.Series, body: pd.Series, url: pd.Series) -> pd.Series:
        def one(s, b, u) -> str:
            if s in (401, 403):
                return "quarantined"
            if s >= 400:
                return "allowed"
            parser = RobotFileParser()
            parser.parse((b or "").splitlines())
            return "allowed" if parser.can_fetch(agent, u) else "quarantined"

        return pd.Series([one(*x) for x in zip(status, body, url, strict=True)], dtype="object")

    return decide


def published_at(value: Column) -> Column:
    """RFC 2822 dates only; without a zone they are UTC. Anything else is null."""
    bare = F.regexp_replace(F.trim(value), "^[A-Za-z]{3},\\s*", "")
    zone = F.regexp_replace(bare, " (GMT|UT|UTC)$", " +0000")
    kind = F.lit("d MMM yyyy HH:mm:ss Z")
    return F.coalesce(F.try_to_timestamp(zone, kind), F.try_to_timestamp(F.concat(bare, F.lit(" +0000")), kind))


@F.pandas_udf(StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b, x) if b and x else None for b, x in zip(base, link, strict=True)], dtype="object")


def read_pages(pages: DataFrame, source_id: str, url: str = "url", html: str = "html") -> DataFrame:
    """Raw documents of fetched pages: url, html, and if there: status, content_type, etag, last_modified, final_url, body_sha256, failure."""
    have = lambda c: F.col(c) if c in pages.columns else F.lit(None).cast("string")
    asked = lambda c: F.col(c) if c in pages.columns else None
    rule = F.coalesce(have("failure"), policy(F.col(url), F.col(html), asked("status"), asked("content_type")))
    rows = pages.withColumn("rule", rule).withColumn("page", F.when(F.col("rule") == "ok", extract_html(F.col(html))))
    address = normalize_url(F.col(url))
    reached = F.coalesce(normalize_url(have("final_url")), address)
    canonical = F.coalesce(normalize_url(absolute(reached, F.col("page.canonical_url"))), reached)
    status = (
        F.when(F.col("rule") == "unsupported", "unsupported").when(F.col("rule") == "request_failed", "unreadable").when(F.col("rule") != "ok", "quarantined")
        .when(F.col("page.text") == "", "unreadable").otherwise("available")
    )
    digest = F.coalesce(have("body_sha256"), F.sha2(F.col(html).cast("binary"), 256))
    about = F.struct(F.col(url).alias("source_url"), canonical.alias("canonical_url"), have("etag").alias("etag"), have("last_modified").alias("last_modified"), F.nullif(F.col("rule"), F.lit("ok")).alias("rule"))
    return rows.select(
        F.lit(source_id).alias("source_id"), F.coalesce(address, F.col(url)).alias("item_id"), F.coalesce(address, F.col(url)).alias("source_uri"), F.lit("text/html").alias("media_type"), status.alias("status"),
        F.col("page.title").alias("title"), F.octet_length(F.col(html).cast("binary")).cast("long").alias("size_bytes"), F.coalesce(have("etag"), have("last_modified"), digest).alias("source_revision"), F.col("page.text").alias("text"),
        F.lit("html-regions/1").alias("parser_version"), F.current_timestamp().alias("fetched_at"), published_at(F.col("page.published_at")).alias("published_at"), F.lit(None).cast("string").alias("language"),
        F.to_json(about).alias("metadata_json"),
    )
