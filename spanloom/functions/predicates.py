"""Admissibility of addresses and files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts whose pages are no media, and networks that must not be fetched from.
PAGE_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "dailymotion.com", "twitch.tv", "tiktok.com", "instagram.com", "facebook.com", "x.com", "twitter.com")
BLOCKED_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
)
#: The same of IPv6, by the first group: its bits under a mask, for fc00::/7, fe80::/10 and ff00::/8. This machine and none (::1, ::) are within the IPv4 addresses.
BLOCKED_NETWORKS_6 = ((0xFE00, 0xFC00), (0xFFC0, 0xFE80), (0xFF00, 0xFF00))
#: Characters that name resolution turns into plain digits and dots.
WIDE_FORMS = "[\uff00-\uffef\u3002]"
#: Names that only ever lead to this machine or network; other names are not resolved here.
LOCAL_NAMES = ("localhost", "localdomain", "internal", "local")
LONGEST_URL = 2048
#: First bytes that are refused, and (offset, bytes) of media containers.
FORBIDDEN_BYTES = (
    (b"PK\x03\x04", "zip archive"), (b"\x7fELF", "ELF executable"), (b"MZ", "Windows executable"), (b"#!", "script"), (b"\xca\xfe\xba\xbe", "Mach-O / Java class"),
    (b"\xcf\xfa\xed\xfe", "Mach-O executable"), (b"%PDF", "PDF document"), (b"<?xml", "XML document"), (b"<", "markup document"),
)
CONTAINER_BYTES = (
    (4, b"ftyp", "mp4"), (0, b"\x1aE\xdf\xa3", "matroska"), (0, b"RIFF", "avi"), (0, b"OggS", "ogg"), (0, b"FLV\x01", "flv"), (0, b"0&\xb2u", "asf"), (0, b"\x00\x00\x01\xba", "mpeg-ps"), (0, b"\x00\x00\x01\xb3", "mpeg-vs"), (0, b"G", "mpeg-ts"),
)
FORBIDDEN = tuple((magic.hex().upper(), name) for magic, name in FORBIDDEN_BYTES)
CONTAINERS = tuple((at, magic.hex().upper(), name) for at, magic, name in CONTAINER_BYTES)
ID = "^[0-9a-f]{32}$"


def url_host(url: Column) -> Column:
    """The host in lower case, an IPv6 address in its brackets, without a dot at its end."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1), r"\.$", "")


def ipv4_number(host: Column) -> Column:
    """The number of a dotted IPv4 address; null for other hosts."""
    part = lambda k: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("long")
    return ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as the one element of an array."""
    return F.transform(F.array(value), use)[0]


def ipv6_groups(host: Column) -> Column:
    """The eight numbers of an IPv6 address in brackets, with or without a zone; null for hosts that are none, or written wrongly."""

    def undotted(inner: Column) -> Column:
        """Four dotted parts at the end as two groups."""
        part = lambda k: F.regexp_extract(inner, r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int")

        def joined(parts: Column) -> Column:
            p = [parts[i] for i in range(4)]
            tail = F.concat(F.lower(F.hex(p[0] * 256 + p[1])), F.lit(":"), F.lower(F.hex(p[2] * 256 + p[3])))
            return F.when(F.array_max(parts) <= 255, F.concat(F.regexp_replace(inner, r"\d{1,3}(?:\.\d{1,3}){3}$", ""), tail)).otherwise(inner)

        return F.when(inner.rlike(r"(?:^|:)\d{1,3}(?:\.\d{1,3}){3}$"), bound(F.array(*[part(k) for k in (1, 2, 3, 4)]), joined)).otherwise(inner)

    def grouped(whole: Column) -> Column:
        sides = F.transform(F.split(whole, "::"), lambda x: F.filter(F.split(x, ":"), lambda g: (g != "") | (x != "")))

        def filled(s: Column) -> Column:
            missing = 8 - F.size(s[0]) - F.size(F.get(s, F.lit(1)))
            with_gap = F.when((F.size(s) == 2) & (missing >= 1), F.concat(s[0], F.array_repeat(F.lit("0"), missing), s[1]))
            return F.when(F.size(s) == 1, s[0]).otherwise(with_gap)

        return bound(sides, filled)

    def numbers(groups: Column) -> Column:
        good = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("long")))

    inner = F.regexp_replace(F.regexp_extract(host, r"^\[([^\]]*)\]$", 1), "%.*$", "")
    return F.when(F.startswith(host, F.lit("[")), bound(bound(bound(inner, undotted), grouped), numbers))


def embedded_ipv4(groups: Column) -> Column:
    """The number of the IPv4 address that an IPv6 one stands for: mapped, translated, compatible, 6to4, NAT64 or Teredo; null for others."""
    g = [F.get(groups, F.lit(i)) for i in range(8)]
    zero = lambda *at: F.greatest(F.lit(0), *[g[i] for i in at]) == 0
    low = g[6] * 65536 + g[7]
    return (
        F.when(zero(0, 1, 2, 3, 4) & g[5].isin(0, 0xFFFF), low)
        .when(zero(0, 1, 2, 3, 5) & (g[4] == 0xFFFF), low)
        .when((g[0] == 0x64) & (g[1] == 0xFF9B) & zero(2, 3, 4, 5), low)
        .when(g[0] == 0x2002, g[1] * 65536 + g[2])
        .when((g[0] == 0x2001) & (g[1] == 0), F.lit(0xFFFFFFFF) - low)
    )


def network_range(cidr: str) -> tuple[int, int]:
    import ipaddress

    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def url_verdict(url: Column) -> Column:
    """ok, or why an address is refused: empty, too long, scheme, no host, page host, blocked network.

    Names are not resolved, but those of this machine and network are blocked, as are addresses written in any but the usual form
    (one number, hexadecimal or octal parts, wide forms), malformed ones in brackets, and IPv6 addresses that stand for IPv4 ones that are blocked by themselves.
    """

    def judged(h: Column) -> Column:
        u, host, groups, number = h["u"], h["host"], h["groups"], h["number"]
        bare = F.regexp_replace(host, r"^www\.", "")
        page = F.lit(False)
        for name in PAGE_HOSTS:
            page |= (bare == name) | F.endswith(bare, F.lit(f".{name}"))
        blocked = F.startswith(host, F.lit("[")) & groups.isNull() | host.rlike(WIDE_FORMS)
        for mask, bits in BLOCKED_NETWORKS_6:
            blocked |= F.coalesce(F.get(groups, F.lit(0)).bitwiseAND(F.lit(mask)) == bits, F.lit(False))
        blocked |= host.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+))*$") & ~host.rlike(r"^((0|[1-9][0-9]{0,2})\.){3}(0|[1-9][0-9]{0,2})$")
        for name in LOCAL_NAMES:
            blocked |= (host == name) | F.endswith(host, F.lit(f".{name}"))
        for low, high in map(network_range, BLOCKED_NETWORKS):
            blocked |= F.coalesce(number.between(low, high), F.lit(False))
        return F.when(u == "", "empty").when(F.length(u) > LONGEST_URL, "too_long").when(~u.rlike("(?i)^https?:"), "scheme").when(host == "", "no_host").when(page, "page_host").when(blocked, "blocked").otherwise("ok")

    trimmed = F.trim(F.coalesce(url, F.lit("")))
    with_host = bound(F.struct(trimmed.alias("u"), url_host(trimmed).alias("host")), lambda h: F.struct(h["u"].alias("u"), h["host"].alias("host"), ipv6_groups(h["host"]).alias("groups")))
    with_number = bound(with_host, lambda h: F.struct(h["u"].alias("u"), h["host"].alias("host"), h["groups"].alias("groups"), F.coalesce(ipv4_number(h["host"]), embedded_ipv4(h["groups"])).alias("number")))
    return bound(with_number, judged)


def media_verdict(header: Column) -> Column:
    """The container family that the first bytes show, or why a file is refused: small, unknown, or what it is."""
    h = F.hex(header)
    out = F.when(F.octet_length(header) < 12, "small")
    for magic, name in FORBIDDEN:
        out = out.when(F.startswith(h, F.lit(magic)), name)
    for offset, magic, name in CONTAINERS:
        out = out.when(F.substring(h, 2 * offset + 1, len(magic)) == magic, name)
    return out.otherwise("unknown")


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(ID), F.lit(False))
