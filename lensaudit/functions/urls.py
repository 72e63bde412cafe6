"""URL expressions: parts, origin, normal form, page role, address guard."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import any_of, strip


def part(url: Column, what: str) -> Column:
    return F.try_parse_url(url, F.lit(what))


def netloc(url: Column) -> Column:
    """Host and port, in the case they were written in; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (netloc(a) == netloc(b))


def bare(url: Column) -> Column:
    """Without slashes at the end."""
    return F.regexp_replace(url, "/+$", "")


def normalize(url: Column) -> Column:
    """Trimmed, with https:// where no scheme is given; null unless http(s) with a host."""
    u = strip(url)
    u = F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u))
    return F.when(scheme(u).isin("http", "https") & (netloc(u) != ""), u)


def segment(url: Column) -> Column:
    """First segment of the path, empty at the root."""
    return F.split_part(F.regexp_replace(path(url), "^/+|/+$", ""), F.lit("/"), F.lit(1))


def is_home(p: Column) -> Column:
    return F.coalesce(p, F.lit("")).isin(*fixed.HOME_PATHS)


def role(p: Column, title: Column, types: Column) -> Column:
    """Role of a page from its path, else from structured types, else from its title."""
    low = F.lower(F.when(F.coalesce(p, F.lit("")) == "", "/").otherwise(p))
    out = F
    for name, needles in fixed.ROLE_PATHS:
        out = out.when(any_of(low, needles), F.lit(name))
    out = out.when(low.isin(*fixed.HOME_PATHS), F.lit("home"))
    for name, some in fixed.ROLE_BY_TYPE:
        out = out.when(F.arrays_overlap(types, F.array(*map(F.lit, some))), F.lit(name))
    for name, needles in fixed.ROLE_BY_TITLE:
        out = out.when(any_of(F.lower(F.coalesce(title, F.lit(""))), needles), F.lit(name))
    return out.otherwise(F.lit("article"))


def expected_types(role_: Column) -> Column:
    out = F
    for name, types in fixed.ROLE_TYPES.items():
        out = out.when(role_ == name, F.array(*map(F.lit, sorted(types))))
    return out.otherwise(F.array().cast("array<string>"))


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null if it is not a dotted quad."""
    octets = [F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("long") for i in range(1, 5)]
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    for o in octets:
        ok = ok & (o <= 255)
    return F.when(ok, octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * (1 << 8) + octets[3])


def blocked_address(ip: Column) -> Column:
    """Whether a literal IPv4 address is one a fetch may not reach. What is no address is blocked."""
    n = ipv4_number(ip)
    inside = F.lit(False)
    for block in fixed.BLOCKED_V4:
        net = ipaddress.ip_network(block)
        inside = inside | n.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(inside, F.lit(True))
