"""URL normalisation, host patterns and the relation of a link's ends."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Ports that go without saying.
DEFAULT_PORTS = {"http": 80, "https": 443}
# Public suffixes of two labels this library knows; any other last label is a suffix by itself.
TWO_LABEL_SUFFIXES = frozenset(
    "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp or.jp ne.jp co.kr com.br com.cn com.mx com.ar com.tr co.in co.za com.sg com.hk com.tw github.io".split()
)
_LABEL = re.compile(r"^(?!-)[a-z0-9_-]{1,63}(?<!-)$")


def normalize_url(url: str | None) -> str | None:
    """An absolute http(s) address in normal form, or None.

    Scheme and host are lower case, the default port and the fragment are gone, an empty path is ``/`` and the query
    stays as it is. Control characters, credentials, bad ports and hosts that are no valid names give None.
    """
    if url is None:
        return None
    u = url.strip()
    if not u or re.search(r"[\x00-\x1f\x7f]", u):
        return None
    try:
        p = urlsplit(u)
        host, port = p.hostname, p.port
    except ValueError:
        return None
    scheme = p.scheme.lower()
    if scheme not in DEFAULT_PORTS or not host or "@" in p.netloc:
        return None
    if ":" in host:
        try:
            host = f"[{ipaddress.IPv6Address(host)}]"
        except ValueError:
            return None
    else:
        try:
            host = host.rstrip(".").encode("idna").decode().lower() if not host.isascii() else host.rstrip(".").lower()
        except UnicodeError:
            return None
        if len(host) > 253 or not all(map(_LABEL.match, host.split("."))):
            return None
    if port is not None and port != DEFAULT_PORTS[scheme]:
        host += f":{port}"
    return f"{scheme}://{host}{p.path or '/'}" + (f"?{p.query}" if p.query or u.split("#")[0].endswith("?") else "")


def host_of(url: str) -> str:
    return (urlsplit(url).hostname or "").lower()


def registrable_domain(host: str) -> str:
    """The label below the public suffix with the suffix; an address stands for itself."""
    if not host or host.startswith("[") or re.fullmatch(r"[\d.]+", host):
        return host
    labels = host.split(".")
    n = 3 if ".".join(labels[-2:]) in TWO_LABEL_SUFFIXES else 2
    return ".".join(labels[-n:])


def relation_scope(source: str, target: str) -> str:
    """self, same_origin, same_host, same_site or external, for two normalised URLs."""
    if source == target:
        return "self"
    a, b = urlsplit(source), urlsplit(target)
    if (a.scheme, a.netloc) == (b.scheme, b.netloc):
        return "same_origin"
    if a.hostname == b.hostname:
        return "same_host"
    if registrable_domain(a.hostname or "") == registrable_domain(b.hostname or ""):
        return "same_site"
    return "external"


def host_matches(host: Column, pattern: str) -> Column:
    """``*`` matches any host, ``*.suffix`` every host below the suffix but not the suffix itself, else equality."""
    if pattern == "*":
        return host.isNotNull()
    if pattern.startswith("*."):
        return F.endswith(host, F.lit(pattern[1:].lower()))
    return host == F.lit(pattern.lower())


@F.pandas_udf(StringType())
def normalized(url: pd.Series) -> pd.Series:
    """``normalize_url`` of a column; each distinct address of a batch is worked out once."""
    values = {u: normalize_url(u) for u in url.dropna().unique()}
    return url.map(values).astype(object).where(url.notna(), None)
