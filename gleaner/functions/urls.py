"""URL rules: display form of links and validity of source URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# scheme, authority and path of a URL reference
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def host(url: Column) -> Column:
    """Host with port, without user information; '' when absent."""
    return F.regexp_replace(F.regexp_extract(url, _SPLIT, 2), r"^.*@", "")


def path(url: Column) -> Column:
    """Decoded path; '' for opaque URLs such as mailto:, NULL when the percent
    coding is broken."""
    raw = F.regexp_extract(url, _SPLIT, 3)
    opaque = (F.regexp_extract(url, _SPLIT, 1) != "") & ~raw.startswith("/") & (
        ~F.regexp_like(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    )
    decoded = F.when(
        F.contains(raw, F.lit("%")), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    ).otherwise(raw)
    return F.when(opaque, F.lit("")).otherwise(decoded)


def parses(url: Column) -> Column:
    """Whether a URL reference can be parsed at all."""
    first_segment_colon = url.rlike(r"^[^/?#:]*:") & ~url.rlike(_SCHEME)
    return (
        ~url.rlike(r"[\x00-\x1F\x7F]")
        & ~first_segment_colon
        & ~host(url).rlike(r'[ <>"^`{}|\\]|%(?![0-9A-Fa-f]{2})')
        & ~host(url).rlike(r"^[^\[]*:.*[^0-9]")
        & path(url).isNotNull()
        & ~path_escape_broken(url)
    )


def path_escape_broken(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3).rlike(r"%(?![0-9A-Fa-f]{2})")


def display_url(source_scheme: Column, source_host: Column, link: Column) -> Column:
    """Scheme of the source, host of the link (else of the source), decoded
    path of the link. Query and fragment are dropped; relative paths are not
    resolved. NULL when the link cannot be parsed."""
    link_host = host(link)
    return F.when(
        parses(link),
        F.concat(
            source_scheme,
            F.lit("://"),
            F.when(link_host != "", link_host).otherwise(source_host),
            path(link),
        ),
    )


def source_url_valid(url: Column) -> Column:
    """A source URL must parse, have a scheme and be more than a scheme."""
    rest = F.regexp_replace(url, _SCHEME, "")
    return parses(url) & (scheme(url) != "") & ~rest.rlike(r"^(//)?#?$")
