"""Column expressions the jobs are made of.  All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from leafmeter.limits import (
    BOT_PATTERNS,
    BROWSER_WORDS,
    CLIENT_PREFIXES,
    DAY,
    LIMITS,
    MAX_VERSION,
)

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_PORT = (
    r"(?::0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])?)?"
)
_IPV6 = r"\[[0-9A-Fa-f:.]+\]"
_WEB = r"(?i)^(?:https?|wss?|ftp):"
# Web addresses take any number of slashes, need a host and read a backslash as a slash.
_WEB_HOST = (
    _WEB
    + r"[/\\]*(?:[^/\\?#]*@)?("
    + _IPV6
    + r"|[^\x00-\x20#/:<>?@\[\\\]^|%\x7f]+)"
    + _PORT
    + r"(?:[/\\?#]|$)"
)
_WEB_ONLY_WWW = _WEB + r"[/\\]*(?:[^/\\?#]*@)?www\." + _PORT + r"(?:[/\\?#]|$)"
_FILE_HOST = (
    r"(?i)^file:(?:[/\\]{2}(" + _IPV6 + r"|[^\x00-\x20#/:<>?@\[\\\]^|%\x7f]*)(?:[/\\?#]|$)"
    r"|[/\\]?(?:[^/\\]|$))"
)
_OTHER_HOST = (
    _SCHEME + r"(?://(?:[^/?#]*@)?(" + _IPV6 + r"|[^\x00\x20#/:<>?@\[\\\]^|]*)"
    + _PORT
    + r"(?:[/?#]|$)|/?(?:[^/]|$))"
)

def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_or_null(value: Column) -> Column:
    return F.when(value != "", value)


# The characters counted as white space around a text.
WHITE_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE_SPACE))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def whole_div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def day_of(seconds: Column) -> Column:
    """Whole UTC days since 1970."""
    return whole_div(seconds, DAY)


def day_text(day: Column) -> Column:
    return F.date_from_unix_date(day.cast("int")).cast("string")


def iso_time(seconds: Column) -> Column:
    """ISO-8601 with milliseconds; the session time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utf8_bytes(value: Column) -> Column:
    return F.octet_length(value).cast("bigint")


def client_ip(cf_ip: Column, forwarded: Column) -> Column:
    """Only NULL falls through to the next source; an empty header is kept as it is."""
    first_hop = trimmed(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(cf_ip, first_hop, F.lit("0.0.0.0"))


def ip_hash(ip: Column, salt: str) -> Column:
    return sha256_hex(F.concat(F.lit(salt + ":"), ip))


def _ascii_lower(value: Column) -> Column:
    """Lower case in which only A-Z turn into a-z (two other letters would, too)."""
    return F.lower(F.replace(F.replace(value, F.lit("\u212a"), F.lit("?")), F.lit("\u0130"), F.lit("?")))


def matches_bot_pattern(lowered: Column, pattern: str) -> Column:
    """Whether lower-cased text holds a pattern: plain text, or a word end after it."""
    if not pattern.endswith(r"\b"):
        return lowered.contains(pattern)
    word = pattern.removesuffix(r"\b")
    return lowered.contains(word) & lowered.rlike(word + r"(?:[^a-z0-9_]|\z)")


def bot_patterns_found(ua: Column, patterns=BOT_PATTERNS) -> Column:
    """The patterns a user agent holds, as an array."""
    return _bind(
        _ascii_lower(ua),
        lambda low: F.array_compact(
            F.array(*[F.when(matches_bot_pattern(low, p), F.lit(p)) for p in patterns])
        ),
    )


def is_bot(ua: Column) -> Column:
    """Crawler rule.  Plain searches, which cost a tenth of one regular expression of all patterns."""
    low = _ascii_lower(ua)
    found = [matches_bot_pattern(low, p) for p in BOT_PATTERNS]
    return F.coalesce(reduce(Column.__or__, found), F.lit(False))


def client_channel(ua: Column, prefixes=CLIENT_PREFIXES) -> Column:
    out = F.when(ua.isNull() | (ua == ""), "other")
    for prefix, client in prefixes:
        out = out.when(ua.startswith(prefix), client)
    return out.when(ua.rlike(BROWSER_WORDS), "web").otherwise("other")


def referrer_written(raw: Column, cut: int = LIMITS.referrer_chars) -> Column:
    """What a raw referrer header is stored as: host without ``www.``, 'other', or NULL."""
    url = F.regexp_replace(raw, r"^[\x00-\x20]+|[\t\n\r]+|[\x00-\x20]+$", "")

    def host(pattern: str) -> Column:
        return F.regexp_extract(url, pattern, 1)

    def stored(found: Column) -> Column:
        return F.substring(F.regexp_replace(found, r"^www\.", ""), 1, cut)

    return (
        F.when(raw.isNull() | (raw == "") | url.rlike(_WEB_ONLY_WWW), F.lit(None))
        .when(url.rlike(_WEB_HOST), stored(F.lower(host(_WEB_HOST))))
        .when(url.rlike(_WEB), "other")
        .when(url.rlike(r"(?i)^file:"), _file_referrer(url, stored))
        .when(url.rlike(_OTHER_HOST), text_or_null(stored(host(_OTHER_HOST))))
        .otherwise("other")
    )


def _file_referrer(url: Column, stored) -> Column:
    host = F.lower(F.regexp_extract(url, _FILE_HOST, 1))
    return (
        F.when(~url.rlike(_FILE_HOST), "other")
        .when(~host.isin("", "localhost"), text_or_null(stored(host)))
    )


def has_scheme(stored: Column) -> Column:
    return stored.rlike(_SCHEME)


def is_bare_host(stored: Column) -> Column:
    """Dot-separated labels of letters, digits and inner hyphens; linear on any input."""
    return stored.rlike(r"^[A-Za-z0-9.-]+\z") & ~stored.rlike(r"^[.-]|[.-]\z|\.\.|\.-|-\.")


def referrer_label(stored: Column, cut: int = LIMITS.referrer_chars) -> Column:
    """What a stored referrer is reported as."""
    return (
        F.when(stored.isNull() | (stored == ""), "direct")
        .when(stored == "other", "other")
        .when(has_scheme(stored), F.coalesce(referrer_written(stored, cut), F.lit("direct")))
        .when(is_bare_host(stored), F.substring(stored, 1, cut))
        .otherwise("other")
    )


def location_label(country: Column, city: Column) -> Column:
    """Takes '' as missing."""
    return (
        F.when(country.isNull() | (country == ""), "unknown")
        .when(city.isNull() | (city == ""), country)
        .otherwise(F.concat(city, F.lit(", "), country))
    )


def object_key(slug: Column, version: Column) -> Column:
    """Version 1 lies at the flat key, later versions below the share's folder."""
    return F.when(version <= 1, F.concat(F.lit("shares/"), slug, F.lit(".html"))).otherwise(
        F.concat(F.lit("shares/"), slug, F.lit("/v"), version.cast("string"), F.lit(".html"))
    )


_FLAT_KEY = r"^shares/([^/]+)\.html\z"


def key_slug(key: Column) -> Column:
    flat = F.regexp_extract(key, _FLAT_KEY, 1)
    nested = F.regexp_extract(key, r"^shares/([^/]+)/", 1)
    return F.when(flat != "", flat).when(nested != "", nested)


def key_version(key: Column) -> Column:
    """Version an object key stands for; NULL for keys no writer of versions makes."""
    number = text_or_null(F.regexp_extract(key, r"^shares/[^/]+/(?:.*/)?v([1-9]\d*)\.html\z", 1))
    parsed = number.try_cast("bigint")
    return F.when(key.rlike(_FLAT_KEY), F.lit(1).cast("bigint")).when(
        parsed.between(2, MAX_VERSION), parsed
    )


def good_bearer(bearer: Column, pattern: str) -> Column:
    return F.coalesce(bearer.rlike(pattern), F.lit(False))


def bearer_key_hash(bearer: Column, pattern: str) -> Column:
    """Hash of the key in a well-formed bearer header, else NULL."""
    return F.when(
        good_bearer(bearer, pattern),
        sha256_hex(F.regexp_replace(bearer, r"^Bearer\s+", "")),
    )


def encode_cursor(created_at: Column, slug: Column) -> Column:
    """URL-safe base64 of ``created_at:slug`` without padding."""
    plain = F.concat(created_at.cast("string"), F.lit(":"), slug)
    return F.rtrim(F.translate(F.base64(plain.cast("binary")), "+/", "-_"), F.lit("="))


def _unpadded(standard: Column) -> Column:
    """Padding may be left out, but where present it must fill the last group of four."""
    full = F.length(standard) % 4 == 0
    return F.when(full, F.regexp_replace(standard, r"={1,2}\z", "")).otherwise(standard)


def _decoded(body: Column) -> Column:
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.when(
        body.rlike(r"^[A-Za-z0-9+/]*\z") & (F.length(body) % 4 != 1),
        F.decode(F.unbase64(padded), "ISO-8859-1"),
    )


def _whole_number(text: Column) -> Column:
    """Number a text stands for if it is a whole one; blank text stands for 0."""
    number = F.when(F.trim(text) == "", F.lit(0.0)).when(
        text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"), text.try_cast("double")
    )
    return _bind(number, lambda n: F.when(n == F.floor(n), n.cast("bigint")))


def _cursor_parts(plain: Column) -> Column:
    at = F.instr(plain, ":")
    slug = F.substr(plain, at + 1)
    number = _whole_number(F.left(plain, at - 1))
    return F.when(
        (at > 0) & (slug != ""), F.struct(number.alias("created_at"), slug.alias("slug"))
    )


def decode_cursor(cursor: Column) -> Column:
    """struct(created_at, slug) of a cursor, NULL where it is malformed."""
    standard = F.translate(F.regexp_replace(cursor, r"[\t\n\f\r ]", ""), "-_", "+/")
    parts = _bind(_bind(_bind(standard, _unpadded), _decoded), _cursor_parts)
    return _bind(parts, lambda p: F.when(p["created_at"].isNotNull(), p))
