"""Url functions: RFC 3986 resolution, identity of urls, href types and url parts.

The parts that a native expression can give are Column expressions; only resolution needs Python, in Arrow batches.
"""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: RFC 3986, appendix B, with the scheme held to the grammar of section 3.1.
_PARTS = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
DEFAULT_PORTS = {"http": "80", "https": "443"}


def split_url(url: str) -> tuple[str | None, str | None, str, str | None, str | None]:
    """Scheme, authority, path, query and fragment; absent parts are None, the path may be empty."""
    return _PARTS.match(url).groups()


def _without_dots(path: str) -> str:
    """RFC 3986, 5.2.4, on segments."""
    if "." not in path:
        return path
    kept: list[str] = []
    segments = path.split("/")
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == ".":
            if last:
                kept.append("")
        elif s == "..":
            if len(kept) > 1 or (kept and kept[0] != ""):
                kept.pop()
            if last:
                kept.append("")
        else:
            kept.append(s)
    out = "/".join(kept)
    return "/" + out if path.startswith("/") and not out.startswith("/") else out


def join_parts(scheme: str | None, authority: str | None, path: str, query: str | None, fragment: str | None) -> str:
    out = f"{scheme}:" if scheme is not None else ""
    if authority is not None:
        out += f"//{authority}"
    out += path
    if query is not None:
        out += f"?{query}"
    return out + (f"#{fragment}" if fragment is not None else "")


def resolve(href: str, base: str | None) -> str | None:
    """`href` against `base` by RFC 3986, 5.2.2; None where the result would have no scheme."""
    scheme, authority, path, query, fragment = split_url(href)
    if scheme is not None:
        return join_parts(scheme, authority, _without_dots(path), query, fragment)
    if base is None:
        return None
    b_scheme, b_authority, b_path, b_query, _ = split_url(base)
    if b_scheme is None:
        return None
    if authority is not None:
        return join_parts(b_scheme, authority, _without_dots(path), query, fragment)
    if not path:
        return join_parts(b_scheme, b_authority, b_path, query if query is not None else b_query, fragment)
    if not path.startswith("/"):
        if b_authority is not None and not b_path:
            path = "/" + path
        else:
            path = b_path[: b_path.rfind("/") + 1] + path
    return join_parts(b_scheme, b_authority, _without_dots(path), query, fragment)


def _decoded(match: re.Match) -> str:
    try:
        return unquote_to_bytes(match.group(0)).decode("utf-8")
    except UnicodeDecodeError:
        return match.group(0).upper()


def web_identity(url: str | None) -> tuple[str | None, str | None]:
    """The form in which http(s) urls are compared, and the host; (None, None) for any other url.

    Scheme and host in lower case, no fragment, no default port, percent escapes decoded once (those that are not
    UTF-8 stay, in upper case); user info, port, path and query count as they are.
    """
    if url is None:
        return None, None
    scheme, authority, path, query, _ = split_url(url.strip(" \t\n\r\f\v"))
    scheme = scheme and scheme.lower()
    if scheme not in DEFAULT_PORTS or not authority:
        return None, None
    user, at, place = authority.rpartition("@")
    host, colon, port = place.rpartition(":") if not place.endswith("]") else (place, "", "")
    if not colon or not (port.isdigit() or not port):
        host, port = place, ""
    host = _ESCAPES.sub(_decoded, host).lower()
    if port in ("", DEFAULT_PORTS[scheme]):
        port = ""
    identity = f"{scheme}://{user}{at}{host}{':' + port if port else ''}" + _ESCAPES.sub(_decoded, path + ("" if query is None else f"?{query}"))
    return identity, host


@F.pandas_udf(StructType().add("url", StringType()).add("host", StringType()))
def resolved_identity(href: pd.Series, base: pd.Series) -> pd.DataFrame:
    """Identity and host of `href` resolved against `base`; null where that is no http(s) url."""
    out = []
    for h, b in zip(href, base):
        full = None if h is None else resolve(h.strip(" \t\n\r\f\v"), None if b is None else b.strip(" \t\n\r\f\v"))
        out.append(web_identity(full))
    return pd.DataFrame(out, columns=["url", "host"], dtype=object)


@F.pandas_udf(StringType())
def url_identity(url: pd.Series) -> pd.Series:
    return pd.Series([web_identity(u)[0] for u in url], dtype=object)


#: Urls and hrefs whose identity needs no parsing: lower-case host, no port, no user, no escapes; `_DOTS` must not match.
_PLAIN_URL = r"^https?://[a-z0-9.\-]+(?:/[^%#]*|\?[^%#]*)?(?:#[\s\S]*)?$"
_PLAIN_HOST = r"^https?://([a-z0-9.\-]+)(?=[/?#]|$)"
_PLAIN_PATH = r"^(?!//)[^%#?:]+(?:\?[^%#]*)?(?:#[\s\S]*)?$"
_DOTS = r"(?:^|/)\.{1,2}(?:[/?#]|$)"
_OTHER_SCHEME = r"^(?!(?i:https?):)[A-Za-z][A-Za-z0-9+.\-]*:"
_EDGES = r"^[\t\n\r\f\x0B ]+|[\t\n\r\f\x0B ]+$"


def identity(href: Column, base: Column) -> Column:
    """As resolved_identity; the usual spellings stay native, and Python gets only the others.

    Native are absolute urls, paths against a base and hrefs of other schemes, as long as nothing in them has to be
    decoded, lowered or taken out.
    """
    h, b = F.regexp_replace(href, _EDGES, ""), F.regexp_replace(base, _EDGES, "")
    bare = F.regexp_replace(h, r"#[\s\S]*$", "")
    directory_ = F.regexp_extract(F.regexp_replace(b, r"[?#][\s\S]*$", ""), r"^(https?://[^/]+/(?:[\s\S]*/)?)", 1)
    plain = h.rlike(_PLAIN_PATH) & ~h.rlike(_DOTS) & b.rlike(_PLAIN_HOST)
    own, root = h.rlike(_PLAIN_URL) & ~F.regexp_replace(h, r"^https?:/", "").rlike(_DOTS), h.startswith("/")
    beside = (directory_ != "") & ~F.contains(directory_, F.lit("%")) & ~F.regexp_replace(directory_, r"^https?:/", "").rlike(_DOTS)
    host_of_base = F.regexp_extract(b, _PLAIN_HOST, 1)
    native = (
        F.when(own, F.struct(bare.alias("url"), F.regexp_extract(h, _PLAIN_HOST, 1).alias("host")))
        .when(plain & root, F.struct(F.concat(F.regexp_extract(b, r"^(https?://[^/?#]+)", 1), bare).alias("url"), host_of_base.alias("host")))
        .when(plain & ~root & beside, F.struct(F.concat(directory_, bare).alias("url"), host_of_base.alias("host")))
        .when(h.rlike(_OTHER_SCHEME), F.struct(F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("host")))
    )
    rest = native.isNull()
    return F.coalesce(native, resolved_identity(F.when(rest, href), F.when(rest, base)))


@F.pandas_udf(StringType())
def resolve_url(href: pd.Series, base: pd.Series) -> pd.Series:
    """RFC 3986 resolution; null where either has no scheme to give."""
    return pd.Series([None if h is None else resolve(h.strip(" \t\n\r\f\v"), b) for h, b in zip(href, base)], dtype=object)


# Native expressions

_SCHEME = r"(?i)^([a-z][a-z0-9+.\-]*):"
_AUTHORITY = r"(?i)^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)"


def _or_null(column: Column) -> Column:
    return F.when(column != "", column)


def protocol(url: Column) -> Column:
    """The scheme with its colon, in lower case; null for a relative url."""
    return _or_null(F.lower(F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.\-]*:)", 1)))


def authority(url: Column) -> Column:
    return _or_null(F.regexp_extract(url, _AUTHORITY, 1))


def hostname(url: Column) -> Column:
    return _or_null(F.regexp_extract(authority(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    """The port as written; null when there is none."""
    return _or_null(F.regexp_extract(authority(url), r":([0-9]+)$", 1)).cast("int")


def username(url: Column) -> Column:
    return _or_null(F.regexp_extract(authority(url), r"^([^:@]*)(?::[^@]*)?@", 1))


def password(url: Column) -> Column:
    return _or_null(F.regexp_extract(authority(url), r"^[^:@]*:([^@]*)@", 1))


def origin(url: Column) -> Column:
    """Scheme, host and port as written; `file://` has no host."""
    return _or_null(F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.\-]*://[^/?#]*)", 1))


def path_and_name(url: Column) -> Column:
    """What follows the authority, without query and fragment."""
    return F.regexp_extract(url, r"(?i)^(?:[a-z][a-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def file_name(url: Column) -> Column:
    """The last path segment of an http(s) or file url that doesn't end in a slash."""
    return _or_null(F.when(url.rlike(r"(?i)^(?:https?|file):"), F.regexp_extract(path_and_name(url), r"([^/]+)$", 1)))


def extension(url: Column) -> Column:
    """From the last dot of the file name; a name with no dot has an empty one, a url without file name none."""
    return F.regexp_extract(file_name(url), r"(\.[^.]*)$", 1)


def base_name(url: Column) -> Column:
    return F.regexp_replace(file_name(url), r"\.[^.]*$", "")


def directory(url: Column) -> Column:
    """The path up to the last slash."""
    return F.regexp_extract(path_and_name(url), r"^(.*/)", 1)


def fragment(href: Column) -> Column:
    """From the first `#`, empty when there is none, null for a null href."""
    return F.regexp_extract(href, r"(?s)(#.*)$", 1)


def with_fragment(href: Column, value: Column) -> Column:
    """`href` with another fragment, which must begin with `#` or be empty; anything else gives null."""
    bare = F.regexp_replace(href, r"(?s)#.*$", "")
    return F.when((value == "") | value.startswith("#"), F.concat(bare, value))


def query_map(url: Column) -> Column:
    """The query string as a map of decoded names and values; a name without `=` has an empty value, the last one wins."""
    raw = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)

    def decoded(part: Column) -> Column:
        return F.coalesce(F.try_url_decode(part), part)

    parts = F.filter(F.split(raw, "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("key"), decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value")))
    keep = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda later: later["key"] == x["key"]))
    return F.map_from_entries(keep)


def _escaped(part: Column) -> Column:
    """Percent-encoded, as in a query string: all but letters, digits and -._~."""
    return F.replace(F.replace(F.replace(F.url_encode(part), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def with_query(url: Column, entries: Column) -> Column:
    """`url` with the query string of an array of (key, value) structs; an empty one leaves no question mark. The fragment stays."""
    query = F.array_join(F.transform(entries, lambda e: F.concat(_escaped(e["key"]), F.lit("="), _escaped(e["value"]))), "&")
    head, tail = F.regexp_extract(url, r"(?s)^([^?#]*)", 1), F.regexp_extract(url, r"(?s)(#.*)$", 1)
    return F.concat(head, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), tail)


def with_query_parameter(url: Column, name: str, value: Column) -> Column:
    """`url` with the parameter set: in its place if it was there, else at the end. A null value gives null."""
    entries = F.map_entries(query_map(url))
    new = F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    there = F.exists(entries, lambda e: e["key"] == name)
    changed = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == name, new["value"]).otherwise(e["value"]).alias("value")))
    return F.when(value.isNotNull(), with_query(url, F.when(there, changed).otherwise(F.concat(entries, F.array(new)))))


def without_query_parameter(url: Column, name: str) -> Column:
    """`url` without the parameter; the others are written anew."""
    return with_query(url, F.filter(F.map_entries(query_map(url)), lambda e: e["key"] != name))


def href_type(href: Column) -> Column:
    """inline, protocolRelative, rootRelative, absolute or relative; null (inline target) and data: are inline."""
    trimmed = F.trim(href)
    return (
        F.when(href.isNull() | trimmed.rlike(r"(?i)^data:"), "inline").when(trimmed.startswith("//"), "protocolRelative").when(trimmed.startswith("/"), "rootRelative")
        .when(trimmed.rlike(r"(?i)^[a-z+]+:"), "absolute").otherwise("relative")
    )


def effective_port(url: Column) -> Column:
    return F.coalesce(port(url), F.when(protocol(url) == "http:", 80).when(protocol(url) == "https:", 443))


def crossorigin(from_url: Column, to_url: Column) -> Column:
    """Whether the target differs in protocol, host or port (with defaults); false for inline ends."""
    differs = ~(protocol(from_url).eqNullSafe(protocol(to_url)) & F.lower(hostname(from_url)).eqNullSafe(F.lower(hostname(to_url))) & effective_port(from_url).eqNullSafe(effective_port(to_url)))
    return F.when(from_url.isNull() | to_url.isNull(), False).otherwise(differs)


def without_fragment(url: Column) -> Column:
    """The identity of an asset's url in a graph."""
    return F.regexp_replace(url, r"(?s)#.*$", "")


def percent_encoded(url: Column) -> Column:
    """Characters outside 0x21-0x7e as percent escapes of their UTF-8 bytes; escapes already there stay."""
    chars = F.split(url, "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(r"^[\x21-\x7e]?$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1"))), "")


def relative_href(from_url: str, to_url: str) -> str:
    """The shortest relative path from one url to another of the same origin; absolute otherwise."""
    fs, fa, fp, _, _ = split_url(from_url)
    ts, ta, tp, tq, tf = split_url(to_url)
    if (fs, fa) != (ts, ta):
        return to_url
    here, there = fp.split("/")[:-1], tp.split("/")
    common = 0
    while common < len(here) and common < len(there) - 1 and here[common] == there[common]:
        common += 1
    out = "../" * (len(here) - common) + "/".join(there[common:])
    if ":" in out.split("/")[0]:
        out = "./" + out
    return join_parts(None, None, out, tq, tf)


def build(to_url: str | None, from_url: str | None, kind: str, non_bare: bool = False) -> str | None:
    """The href of `kind` (rootRelative, relative, protocolRelative, absolute) that leads from one url to the other."""
    if to_url is None:
        return None
    scheme, authority_, path, query, frag = split_url(to_url)
    if kind == "absolute" or from_url is None:
        return to_url
    if kind == "protocolRelative":
        return join_parts(None, authority_, path, query, frag)
    b_scheme, b_authority, *_ = split_url(from_url)
    if (b_scheme, b_authority) != (scheme, authority_):
        return to_url
    if kind == "rootRelative":
        return join_parts(None, None, path or "/", query, frag)
    out = relative_href(from_url, to_url)
    return f"./{out}" if non_bare and not out.startswith((".", "/")) else out


@F.pandas_udf(StringType())
def build_href(to_url: pd.Series, from_url: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else build(t, f, k) for t, f, k in zip(to_url, from_url, kind)], dtype=object)


def data_url(content_type: Column, raw: Column) -> Column:
    """The shorter of the percent-encoded and the base64 form of the bytes; bytes that aren't UTF-8 have only the latter."""
    text = F.try_validate_utf8(raw.cast("string"))
    escaped = F.regexp_replace(F.url_encode(text), r"\+", "%20")
    plain = F.concat(F.lit("data:"), F.coalesce(content_type, F.lit("")), F.lit(","), escaped)
    coded = F.concat(F.lit("data:"), F.coalesce(content_type, F.lit("")), F.lit(";base64,"), F.base64(raw))
    return F.when(F.octet_length(plain) <= F.octet_length(coded), plain).otherwise(coded)


def resolve_in_root(href: str, base: str | None, root: str, canonical_root: str | None = None) -> str | None:
    """`href` in a graph: root-relative hrefs from files resolve against the graph's root, without the path of the
    canonical root; urls below the canonical root are urls below the root."""
    href = href.strip(" \t\n\r\f\v")
    path = split_url(canonical_root)[2] if canonical_root else "/"
    if base is not None and base.lower().startswith("file:") and href.startswith("/") and not href.startswith("//"):
        full = root + (href[len(path) :] if href.startswith(path) else href[1:])
    else:
        full = resolve(href, base)
    if full is not None and canonical_root:
        for known in (canonical_root, "http:" + canonical_root, "https:" + canonical_root) if canonical_root.startswith("//") else (canonical_root,):
            if full.startswith(known):
                return root + full[len(known) :]
    return full


def is_canonical(href: Column, canonical_root: str) -> Column:
    """Whether an href is written with the canonical root."""
    return F.coalesce(F.trim(href).startswith(canonical_root), F.lit(False))


def canonical_href(url: Column, root: str, canonical_root: str) -> Column:
    """A url below the root as one below the canonical root; others as they are."""
    return F.when(url.startswith(root), F.concat(F.lit(canonical_root), F.substr(url, F.lit(len(root) + 1)))).otherwise(url)
