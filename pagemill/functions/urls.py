"""URL expressions: parts, host name, reference resolution. All native, NULL where a URL is not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.columns import let

# --- fixed values (RFC 3986) --------------------------------------------------------------------------------
# scheme, authority after a scheme, authority without a scheme, path, query with "?", fragment with "#"
URL_PATTERN = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?|//(?!/)([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
)
CONTROL = r"^[^#]*[\x00-\x1F\x7F]"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
BAD_HOST_CHAR = r"""[\x00-\x7F&&[^A-Za-z0-9\-_.~!$&'()*+,;=:\[\]<>"%]]"""
BAD_HOST_ESCAPE = r"%(?!25|[89A-Fa-f][0-9A-Fa-f])"
BAD_USER_CHAR = r"[^A-Za-z0-9\-._~!$&'()*+,;=%@:]"
LEGAL_PATH = r"^[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]%]*$"
KEPT_IN_PATH = r"A-Za-z0-9\-_.~$&+,/:;=@"
LEGAL_FRAGMENT = r"^[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]%?]*$"
KEPT_IN_FRAGMENT = r"A-Za-z0-9\-_.~$&+,/:;=@?!()*"
KEPT_IN_USER = r"A-Za-z0-9\-_.~$&+,;="
KEPT_IN_HOST = r"""A-Za-z0-9\-_.~!$&'()*+,;=:\[\]<>\""""
# ------------------------------------------------------------------------------------------------------------


def _group(url: Column, n: int) -> Column:
    return F.regexp_extract(url, URL_PATTERN, n)


def _split(url: Column) -> Column:
    """The raw parts of a URL, to be bound once with `let`. ``has_scheme`` and ``slashes`` tell an absent part
    from an empty one; ``query`` and ``fragment`` keep their leading mark."""
    authority = F.concat(_group(url, 2), _group(url, 3))
    scheme = _group(url, 1)
    rest = F.when(scheme == "", url).otherwise(F.substring(url, F.length(scheme) + 2, F.length(url)))
    return F.struct(
        url.alias("url"),
        F.lower(scheme).alias("scheme"),
        authority.alias("authority"),
        F.regexp_extract(authority, r"([^@]*)$", 1).alias("host"),
        _group(url, 4).alias("path"),
        _group(url, 5).alias("query"),
        _group(url, 6).alias("fragment"),
        rest.startswith("//").alias("slashes"),
    )


def _host_name(host: Column) -> Column:
    """Host without a valid port and without the brackets of an IPv6 literal; case kept."""
    return F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^\[(.*)\]$", "$1")


def percent_decode(value: Column) -> Column:
    """Percent-decoded text; "+" stays "+"."""
    return F.when(
        value.contains("%"), F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    ).otherwise(value)


def percent_encode(value: Column, kept: str) -> Column:
    """Decode ``value``, then percent-encode every byte outside ``kept`` (the inside of a character class)."""

    def piece(t: Column) -> Column:
        one_byte = F.chr(F.conv(F.substring(t, 2, 2), 16, 10).cast("long"))
        return (
            F.when(
                t.startswith("%"),
                F.when((F.upper(t) < "%80") & one_byte.rlike(f"^[{kept}]$"), one_byte).otherwise(F.upper(t)),
            )
            .when(t.rlike(f"^[{kept}]"), t)
            .otherwise(F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "%$1"))
        )

    pieces = F.regexp_extract_all(value, F.lit(f"(?s)%[0-9A-Fa-f]{{2}}|[{kept}]+|[^{kept}%]+"), 0)
    return F.array_join(F.transform(pieces, piece), "")


def _legal_path(path: Column) -> Column:
    return F.when(path.rlike(LEGAL_PATH), path).otherwise(percent_encode(path, KEPT_IN_PATH))


def _legal_fragment(fragment: Column) -> Column:
    """``fragment`` with its "#", or "" when there is nothing after it."""
    body = F.substring(fragment, 2, 2147483647)
    return F.when(F.length(fragment) <= 1, F.lit("")).when(body.rlike(LEGAL_FRAGMENT), fragment).otherwise(
        F.concat(F.lit("#"), percent_encode(body, KEPT_IN_FRAGMENT))
    )


def _legal_authority(u: Column) -> Column:
    host = u["host"]
    legal_host = F.when(host.rlike(r"^[\x00-\x7F]*$"), host).otherwise(percent_encode(host, KEPT_IN_HOST))
    user = F.regexp_extract(u["authority"], r"^(.*)@", 1)
    word = F.regexp_extract(user, r"^[^:]*:(.*)$", 1)
    legal_user = F.concat(
        percent_encode(F.regexp_extract(user, r"^[^:]*", 0), KEPT_IN_USER),
        F.when(user.contains(":"), F.concat(F.lit(":"), percent_encode(word, KEPT_IN_USER))).otherwise(F.lit("")),
        F.lit("@"),
    )
    return F.when(u["authority"].contains("@"), F.concat(legal_user, legal_host)).otherwise(legal_host)


def _is_opaque(u: Column) -> Column:
    """``mailto:a@b``: a scheme and something that is not a path."""
    return (u["scheme"] != "") & ~u["slashes"] & (u["path"] != "") & ~u["path"].startswith("/")


def _is_valid(u: Column) -> Column:
    host, path = u["host"], u["path"]
    bad_authority = (u["authority"] != "") & (
        host.rlike(f"{BAD_HOST_CHAR}|{BAD_HOST_ESCAPE}")
        | F.when(host.startswith("["), ~host.rlike(r"^\[.*\](:[0-9]*)?$")).otherwise(
            host.rlike(r":[^:]*[^0-9:][^:]*$")
        )
        | F.regexp_extract(u["authority"], r"^(.*)@", 1).rlike(f"{BAD_USER_CHAR}|{BAD_ESCAPE}")
    )
    return ~(
        u["url"].rlike(CONTROL)
        | ((u["scheme"] == "") & ~u["slashes"] & path.rlike(r"^[^/]*:"))
        | (path.rlike(BAD_ESCAPE) & ~_is_opaque(u))
        | u["fragment"].rlike(BAD_ESCAPE)
        | bad_authority
    )


def is_valid_url(url: Column) -> Column:
    """False where a URL or reference has control characters, a broken percent escape, a bad host or port, no
    scheme before a leading colon, or a colon in the first segment of a relative path."""
    return let(_split(url), _is_valid)


def url_parts(url: Column) -> Column:
    """``struct<scheme, host, hostname, path, query, fragment>``; absent parts are ''. NULL for an invalid URL."""
    return let(
        _split(url),
        lambda u: F.when(
            _is_valid(u),
            F.struct(
                u["scheme"].alias("scheme"),
                u["host"].alias("host"),
                percent_decode(_host_name(u["host"])).alias("hostname"),
                u["path"].alias("path"),
                F.regexp_replace(u["query"], r"^\?", "").alias("query"),
                F.regexp_replace(u["fragment"], r"^#", "").alias("fragment"),
            ),
        ),
    )


def url_host(url: Column) -> Column:
    """Host with its port, as robots tables are keyed."""
    return F.regexp_extract(F.concat(_group(url, 2), _group(url, 3)), r"([^@]*)$", 1)


def url_hostname(url: Column) -> Column:
    """Host without port; '' when the URL has none (``mailto:``)."""
    return percent_decode(_host_name(url_host(url)))


def url_path(url: Column) -> Column:
    """Percent-decoded path, without query and fragment."""
    path = _group(url, 4)
    return F.coalesce(percent_decode(path), path)


def _remove_dot_segments(path: Column) -> Column:
    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", F.when(F.size(kept) == 0, F.array(F.lit(""))).otherwise(kept))
            .when(
                segment == "..",
                F.when(F.size(kept) <= 1, F.array().cast("array<string>")).otherwise(
                    F.slice(kept, F.lit(1), F.size(kept) - 1)
                ),
            )
            .otherwise(F.array_append(kept, segment))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    tail = F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.lit("/"), joined, tail), "^//", "/")


def _clean_path(path: Column) -> Column:
    return (
        F.when(path == "", path)
        .when(path.rlike(r"(^|/)\.\.?(/|$)"), _remove_dot_segments(path))
        .when(path.startswith("/"), path)
        .otherwise(F.concat(F.lit("/"), path))
    )


def _resolved(base: Column, ref: Column) -> Column:
    own = (ref["scheme"] != "") | (ref["authority"] != "")
    same_document = ~own & (ref["path"] == "") & (ref["query"] == "")
    scheme = F.when(ref["scheme"] != "", ref["scheme"]).otherwise(base["scheme"])
    authority = F.when(own, _legal_authority(ref)).otherwise(_legal_authority(base))
    path = _clean_path(
        F.when(own | ref["path"].startswith("/"), _legal_path(ref["path"]))
        .when(ref["path"] == "", _legal_path(base["path"]))
        .otherwise(F.concat(F.regexp_extract(_legal_path(base["path"]), r"(?s)^(.*/)", 1), _legal_path(ref["path"])))
    )
    query = (
        F.when(~same_document, ref["query"])
        .when(base["query"] == "?", F.lit(""))
        .otherwise(base["query"])
    )
    fragment = _legal_fragment(F.when(same_document & (F.length(ref["fragment"]) <= 1), base["fragment"]).otherwise(ref["fragment"]))
    mark = F.when(
        F.when(own, (ref["authority"] != "") | (ref["slashes"] & (ref["path"] != ""))).otherwise(base["authority"] != ""),
        F.lit("//"),
    ).otherwise(F.lit(""))
    colon = F.when(scheme == "", F.lit("")).otherwise(F.lit(":"))
    return F.concat(scheme, colon, mark, authority, path, query, fragment)


def _resolve(base: Column, ref: Column) -> Column:
    return F.when(
        _is_valid(ref),
        F.when(
            _is_opaque(ref),
            F.concat(ref["scheme"], F.lit(":"), ref["path"], ref["query"], _legal_fragment(ref["fragment"])),
        ).otherwise(_resolved(base, ref)),
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute URL of ``ref`` seen from ``base`` (RFC 3986 section 5); NULL if either is not valid.

    Query and fragment are kept, host case and trailing slashes are not touched, a path with illegal characters
    is percent-encoded again.
    """
    return let(
        F.struct(_split(base).alias("b"), _split(ref).alias("r")),
        lambda u: F.when(_is_valid(u["b"]), _resolve(u["b"], u["r"])),
    )


def resolve_hrefs(base: Column, links: Column) -> Column:
    """``array<struct<ord, href>>`` to ``array<struct<ord, href, url>>``; the base is taken apart once, links that
    do not resolve are left out."""

    def resolved(b: Column) -> Column:
        with_url = F.transform(
            links,
            lambda x: F.struct(
                x["ord"].alias("ord"),
                x["href"].alias("href"),
                let(_split(x["href"]), lambda r: _resolve(b, r)).alias("url"),
            ),
        )
        return F.when(_is_valid(b), F.filter(with_url, lambda x: x["url"].isNotNull()))

    return let(_split(base), resolved)


def hostname_suffixes(hostname: Column, lengths: list[int]) -> Column:
    """The endings of ``hostname`` that have one of the given lengths."""
    return F.filter(
        F.transform(
            F.array(*[F.lit(n) for n in lengths]),
            lambda n: F.when(F.length(hostname) >= n, F.substring(hostname, F.length(hostname) - n + 1, n)),
        ),
        lambda s: s.isNotNull(),
    )
