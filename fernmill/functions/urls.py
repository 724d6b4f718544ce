"""URL, hash and binary expressions."""

from __future__ import annotations

import ipaddress
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernmill.functions import fixed
from fernmill.functions.fixed import rx
from fernmill.functions.text import let, some_text, text_or_empty

_AUTHORITY = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(url), _AUTHORITY, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(text_or_empty(url), _AUTHORITY, 2)


def _rest(url: Column) -> Column:
    return F.regexp_replace(text_or_empty(url), _AUTHORITY, "")


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host without port, user or a leading www."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.lower(bare), r"^www\.", "")


def page_url(url: Column) -> Column:
    """A page's address: https and / where missing, without parameters and fragment."""
    whole = F.concat(F.coalesce(some_text(scheme(url)), F.lit("https")), F.lit("://"), authority(url), F.regexp_replace(F.coalesce(some_text(path(url)), F.lit("/")), ";[^/]*$", ""))
    return F.concat(whole, F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit("")))


def published_url(url: Column) -> Column:
    """One form for addresses that mean one page; empty if it isn't a web address."""
    clean = F.trim(text_or_empty(url))
    port = F.regexp_extract(authority(clean), r":(\d+)$", 1)
    own = F.regexp_replace(F.coalesce(some_text(path(clean)), F.lit("/")), "/{2,}", "/")
    own = F.when(own == "/", own).otherwise(F.rtrim(own, F.lit("/")))
    out = F.concat(F.lit("https://"), host(clean), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")), own, F.when(query(clean) != "", F.concat(F.lit("?"), query(clean))).otherwise(F.lit("")))
    return F.when(scheme(clean).isin("http", "https") & (host(clean) != ""), out).otherwise(F.lit(""))


def scope(restaurant: Column, city: Column, url: Column) -> Column:
    """What an offer replaces within: place, city and page."""
    page = F.rtrim(F.split_part(text_or_empty(url), F.lit("#"), F.lit(1)), F.lit("/"))
    return F.struct(F.lower(text_or_empty(restaurant)).alias("restaurant"), F.lower(text_or_empty(city)).alias("city"), F.lower(page).alias("page"))


def homepage(url: Column) -> Column:
    return F.concat(F.coalesce(some_text(scheme(url)), F.lit("https")), F.lit("://"), authority(url), F.lit("/"))


def is_blocked(url: Column) -> Column:
    """A social or ordering site, or one under it."""
    names = "|".join(h.replace(".", r"\.") for h in fixed.BLOCKED_HOSTS)
    return host(url).rlike(rf"(?:^|\.)(?:{names})$")


# First and last address of networks that aren't on the public web.
LOCAL_NETWORKS = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
]
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _number(address: str) -> int:
    return int.from_bytes(map(int, address.split(".")), "big")


def is_safe(url: Column) -> Column:
    """Web addresses outside local networks; addresses in numbers must be globally reachable.

    Of version 6 only global unicast counts, without the networks for tunnels,
    protocols and documents.
    """
    four = "^" + r"\.".join([_OCTET] * 4) + "$"
    networks = F.array(*(F.struct(F.lit(_number(lo)).alias("lo"), F.lit(_number(hi)).alias("hi")) for lo, hi in LOCAL_NETWORKS))

    def judged(name: Column) -> Column:
        six = F.regexp_extract(name, r"^\[([0-9a-f:.]+)\]", 1)
        far = six.rlike("^[23][0-9a-f]{3}:") & ~six.rlike("^(2001:(0{0,3}[0-9a-f]?:|0?[01][0-9a-f]{0,2}:|:|0?db8:)|2002:)")
        return F.when(name.startswith("["), far).otherwise(let(F.regexp_replace(name, r":\d*$", ""), named))

    def named(bare: Column) -> Column:
        number = F.aggregate(F.split(bare, r"\."), F.lit(0).cast("long"), lambda n, part: n * 256 + part.cast("long"))
        public = let(number, lambda n: ~F.exists(networks, lambda x: n.between(x["lo"], x["hi"])))
        return F.when(bare.rlike(four), public).otherwise((bare != "") & (bare != "localhost") & ~bare.endswith(".local"))

    name = F.regexp_replace(F.lower(authority(url)), "^.*@", "")
    return F.coalesce(scheme(url).isin("http", "https") & let(name, judged), F.lit(False))


def offer_id(name: Column, url: Column, text: Column) -> Column:
    stable = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.left(F.sha1(F.concat_ws("|", name, url, stable)), F.lit(16))


def page_key(place_id: Column, url: Column) -> Column:
    return F.left(F.sha1(F.concat_ws("|", place_id, url)), F.lit(20))


def assets_hash(assets: Column) -> Column:
    """Hash of a list of (url, content_hash); empty for none."""
    joined = F.array_join(F.transform(assets, lambda a: F.concat_ws(":", a["url"], a["content_hash"])), "|")
    return F.when(F.size(assets) > 0, F.sha2(joined, 256)).otherwise(F.lit(""))


def sniff_type(data: Column, declared: Column) -> Column:
    """Type of a picture or PDF: the declared one if supported, else by its first bytes, else empty."""
    mime = F.lower(F.trim(F.split_part(text_or_empty(declared), F.lit(";"), F.lit(1))))
    return F.when(mime.isin(fixed.VISUAL_TYPES), mime).otherwise(F.coalesce(_magic(data, [t for t in fixed.MAGIC if t != "image/x-icon"]), F.lit("")))


def image_extension(data: Column, declared: Column) -> Column:
    """File extension of an image by its first bytes, else by its declared type, else null."""
    found = F.coalesce(_magic(data, [t for t in fixed.MAGIC if t != "application/pdf"]), declared)
    return F.create_map(*(F.lit(x) for pair in fixed.EXTENSIONS.items() for x in pair))[found]


def _magic(data: Column, types: list[str]) -> Column:
    head = F.hex(F.substring(data, 1, 12))
    tests = [F.when(head.rlike("^(?:" + fixed.MAGIC[t].replace(" ", "|") + ")"), F.lit(t)) for t in types]
    return F.coalesce(*tests, F.when(head.rlike("^52494646.{8}57454250"), F.lit("image/webp")))


def _first_bytes(content: bytes) -> str | None:
    """A type by the first bytes, in a Python worker."""
    head = content[:12].hex().upper()
    if content.startswith(b"RIFF") and content[8:12] == b"WEBP":
        return "image/webp"
    return next((mime for mime, marks in fixed.MAGIC.items() if any(head.startswith(m) for m in marks.split())), None)


def picture_kind(content: bytes, declared: str) -> str | None:
    """The file extension of a picture of at least 32 bytes, in a Python worker; see :func:`image_extension`."""
    found = _first_bytes(content)
    known = found if found and found != "application/pdf" else declared.partition(";")[0].strip().lower()
    return fixed.EXTENSIONS.get(known) if len(content) >= 32 else None


def visual_kind(content: bytes, declared: str) -> str | None:
    """The type of a picture or PDF of a size that can be looked at, in a Python worker; see :func:`sniff_type`."""
    mime = declared.partition(";")[0].strip().lower()
    kind = mime if mime in fixed.VISUAL_TYPES else _first_bytes(content)
    return kind if kind in fixed.VISUAL_TYPES and fixed.LEAST_ASSET <= len(content) <= fixed.MOST_ASSET else None


def encode_component(value: Column) -> Column:
    """A value as it stands in an address: spaces as %20, and ``!'()*~`` as they are."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for mark in "!'()~":
        out = F.replace(out, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return out


def map_url(name: Column, address: Column, known: Column) -> Column:
    search = F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), encode_component(F.trim(F.concat_ws(" ", name, address))))
    return F.coalesce(some_text(known), search)


def report_url(new_issue: str, restaurant: Column, city: Column, source: Column) -> Column:
    """A link that opens a report of a missing or wrong offer at a tracker's address for new issues."""
    sections = [("Restaurant", restaurant), ("City", city), ("What needs attention?", F.lit("Missing or incorrect deal")), ("Official source URL", text_or_empty(source))]
    told = [part for name, value in sections for part in (F.lit(f"### {name}\n"), value, F.lit("\n\n"))]
    hint = F.lit("### Details\n<!-- Describe what is missing or incorrect, including the right day, time, price, or expiration. -->")
    title = F.concat(F.lit("[Deal report] "), restaurant, F.lit(" - "), city)
    return F.concat(F.lit(new_issue + "?title="), F.url_encode(title), F.lit("&body="), F.url_encode(F.concat(*told, hint)))


def phone_url(phone: Column) -> Column:
    return F.concat(F.lit("tel:"), F.regexp_replace(text_or_empty(phone), r"[^\d+]", ""))


def brand_color(value: Column) -> Column:
    """``#rrggbb`` of a hex or rgb() colour; null if it isn't one or is nearly white."""
    v = F.lower(F.trim(text_or_empty(value)))
    three = F.regexp_replace(v, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    rgb = r"^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$"
    part = lambda i: F.lpad(F.lower(F.hex(F.least(F.regexp_extract(v, rgb, i).cast("int"), F.lit(255)))), 2, "0")
    color = F.when(v.rlike(rgb), F.concat(F.lit("#"), part(1), part(2), part(3))).when(three.rlike("^#[0-9a-f]{6}$"), three)
    channel = lambda i: F.conv(F.substring(color, i, 2), 16, 10).cast("int")
    return F.when(F.least(channel(2), channel(4), channel(6)) < 238, color)


def is_direct_visual(url: Column) -> Column:
    return F.coalesce(url.rlike(rx(fixed.DIRECT_VISUAL)), F.lit(False))


def _public(url: str) -> bool:
    """Whether an address is on the public web by its name; names are not looked up."""
    parts = urlsplit(url)
    name = (parts.hostname or "").lower()
    local = not name or name == "localhost" or name.endswith(".local")
    try:
        return parts.scheme in ("http", "https") and not local and ipaddress.ip_address(name).is_global
    except ValueError:
        return parts.scheme in ("http", "https") and not local


def asset_address(base: str, value: str, srcset: bool = False) -> str | None:
    """The address an asset reference stands for, encoded and without fragment; null if it is unsafe or inline."""
    bare = value.split(",")[0]
    bare = (bare.split(" ")[0] if srcset else " ".join(bare.split())).strip("'\"").replace("\\/", "/")
    if not bare or bare.partition(":")[0] in ("data", "blob", "javascript"):
        return None
    try:
        parts = urlsplit(urljoin(base, bare))
        url = urlunsplit((parts.scheme, parts.netloc, quote(parts.path, safe="/%:@"), quote(parts.query, safe="=&%/:,+"), ""))
        return url if _public(url) else None
    except ValueError:
        return None
