"""URL operators (U1-U10, P1-P5) built from Spark built-ins only.

``parse_url`` raises under ANSI mode and keeps host case, so URLs are split here with
regular expressions that follow Python's ``urllib.parse`` rules (scheme detection, netloc,
``;params`` of the last segment, query, fragment).

Every operator is ``DataFrame -> DataFrame``: each intermediate part is projected once as
a column (``withColumns`` stages) and later steps refer to it by name. Nesting the parts as
one expression would copy each sub-tree into every place that uses it, and the tree would
grow exponentially; Catalyst keeps these projections apart because the parts are not cheap.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.config import IGNORED_EXTENSIONS
from pagemill.functions.text import col, first_nonempty, nonempty, py_strip, slugify

# Query keys dropped by normalisation (plus every key starting "utm_").
TRACKING_KEYS = ("gclid", "fbclid", "mc_cid", "mc_eid", "ref", "source")
TRACKING_PREFIXES = ("utm_",)
BLOCKED_NAMES = ("localhost", "127.0.0.1", "::1")

# IPv4 blocks that CPython 3.13 reports as private, loopback or link-local
# (first address, last address); 192.0.0.9 and 192.0.0.10 are excepted.
_IPV4_PRIVATE = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
)
_IPV4_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_tmp_ids = itertools.count()


def _ip_int(dotted: str) -> int:
    a, b, c, d = (int(x) for x in dotted.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def _tmp() -> str:
    return f"__u{next(_tmp_ids)}_"


# ------------------------------------------------------------------ splitting


def clean_url(c) -> Column:
    """What ``urlsplit`` does first: drop tab / CR / LF anywhere, strip C0 and space on the left."""
    return F.regexp_replace(F.regexp_replace(col(c), r"[\t\r\n]", ""), r"^[\x{00}-\x{20}]+", "")


def hostname_of_netloc(netloc) -> Column:
    """``urlparse(u).hostname`` or '': after the last '@', inside brackets or before ':',
    lower-cased up to a '%' zone."""
    hostinfo = F.regexp_extract(col(netloc), r"(?s)([^@]*)\z", 1)
    h = F.when(hostinfo.contains("["), F.regexp_extract(hostinfo, r"(?s)\[([^\]]*)", 1)).otherwise(
        F.regexp_extract(hostinfo, r"(?s)^([^:]*)", 1)
    )
    return F.concat(F.lower(F.regexp_extract(h, r"(?s)^([^%]*)", 1)), F.regexp_extract(h, r"(?s)(%.*)\z", 1))


def with_url_parts(df: DataFrame, src: str, prefix: str) -> DataFrame:
    """Add ``{prefix}scheme, netloc, path, params, query, fragment, host`` like ``urlparse``."""
    t = _tmp()
    df = df.withColumn(t + "c", clean_url(src))
    df = df.withColumn(t + "s", F.regexp_extract(t + "c", _SCHEME, 1))
    df = df.withColumn(
        t + "r",
        F.when(F.col(t + "s") == "", F.col(t + "c")).otherwise(F.substring(t + "c", F.length(t + "s") + 2, 1 << 30)),
    )
    has_net = F.col(t + "r").startswith("//")
    df = df.withColumns(
        {
            prefix + "netloc": F.when(has_net, F.regexp_extract(t + "r", r"(?s)^//([^/?#]*)", 1)).otherwise(F.lit("")),
            t + "a": F.when(has_net, F.regexp_extract(t + "r", r"(?s)^//[^/?#]*(.*)\z", 1)).otherwise(F.col(t + "r")),
        }
    )
    a = F.col(t + "a")
    df = df.withColumns(
        {
            prefix + "fragment": F.when(a.contains("#"), F.regexp_extract(a, r"(?s)^[^#]*#(.*)\z", 1)).otherwise(F.lit("")),
            t + "n": F.regexp_extract(a, r"(?s)^([^#]*)", 1),
        }
    )
    n = F.col(t + "n")
    df = df.withColumns(
        {
            prefix + "query": F.when(n.contains("?"), F.regexp_extract(n, r"(?s)^[^?]*\?(.*)\z", 1)).otherwise(F.lit("")),
            t + "p": F.regexp_extract(n, r"(?s)^([^?]*)", 1),
        }
    )
    # ;params of the last path segment (http and https use params)
    pm = r"(?s)^((?:.*/)?[^/;]*);([^/]*)\z"
    p = F.col(t + "p")
    df = df.withColumns(
        {
            prefix + "scheme": F.lower(F.col(t + "s")),
            prefix + "path": F.when(p.rlike(pm), F.regexp_extract(p, pm, 1)).otherwise(p),
            prefix + "params": F.when(p.rlike(pm), F.regexp_extract(p, pm, 2)).otherwise(F.lit("")),
            prefix + "host": hostname_of_netloc(prefix + "netloc"),
        }
    )
    return df.drop(t + "c", t + "s", t + "r", t + "a", t + "n", t + "p")


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    """``urlunsplit`` without fragment (all arguments are plain column references)."""
    with_slash = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    body = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, with_slash))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when(scheme.isin("http", "https") & ((path == "") | path.startswith("/")), F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    out = F.when(scheme != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)
    return F.when(query != "", F.concat(out, F.lit("?"), query)).otherwise(out)


# ------------------------------------------------------------------ U2: query


def _unquote_plus(c: Column) -> Column:
    """``unquote(s.replace('+', ' '))``: a '%' without two hex digits stays literal."""
    escaped = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(escaped), F.replace(c, F.lit("+"), F.lit(" ")))


def _quote_plus(c: Column) -> Column:
    """``quote_plus(s, safe='')``: Java's encoder differs only on '~' and '*'."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _split_pair(x: Column) -> Column:
    k = F.regexp_extract(x, r"(?s)^([^=]*)", 1)
    v = F.when(x.contains("="), F.regexp_extract(x, r"(?s)^[^=]*=(.*)\z", 1)).otherwise(F.lit(""))
    return F.struct(_unquote_plus(k).alias("k"), _unquote_plus(v).alias("v"))


def _not_tracking(p: Column) -> Column:
    lk = F.lower(p["k"])
    tracked = lk.isin(*TRACKING_KEYS)
    for pre in TRACKING_PREFIXES:
        tracked = tracked | lk.startswith(pre)
    return ~tracked


def clean_query(query) -> Column:
    """parse_qsl(keep_blank_values) -> drop tracking keys -> sort by decoded (key, value) -> urlencode."""
    fields = F.filter(F.split(col(query), "&", -1), lambda x: x != "")
    kept = F.array_sort(F.filter(F.transform(fields, _split_pair), _not_tracking))
    return F.array_join(F.transform(kept, lambda p: F.concat(_quote_plus(p["k"]), F.lit("="), _quote_plus(p["v"]))), "&")


# ------------------------------------------------------------------ U1


def with_normalized_url(df: DataFrame, src: str, out: str) -> DataFrame:
    """U1 ``normalize_url``: '' for NULL / empty input and for schemes other than http(s)."""
    t = _tmp()
    u = F.regexp_extract(clean_url(src), r"(?s)^([^#]*)", 1)  # urldefrag
    df = df.withColumn(t + "d", u)
    df = df.withColumn(
        t + "u",
        F.when(F.col(t + "d").rlike(_SCHEME), F.col(t + "d")).otherwise(F.concat(F.lit("https://"), F.col(t + "d"))),
    )
    df = with_url_parts(df, t + "u", t)
    df = df.withColumn(t + "p1", F.regexp_replace(F.coalesce(nonempty(t + "path"), F.lit("/")), "/+", "/"))
    p1 = F.col(t + "p1")
    p2 = F.when((p1 != "/") & p1.endswith("/"), F.regexp_replace(p1, "/+\\z", "")).otherwise(p1)
    df = df.withColumn(t + "p2", p2)
    params = F.col(t + "params")
    df = df.withColumns(
        {
            t + "p3": F.when(params != "", F.concat(F.col(t + "p2"), F.lit(";"), params)).otherwise(F.col(t + "p2")),
            t + "q": clean_query(t + "query"),
        }
    )
    scheme = F.col(t + "scheme")
    built = _unsplit(scheme, F.col(t + "netloc"), F.col(t + "p3"), F.col(t + "q"))
    s = F.col(src)
    df = df.withColumn(
        out, F.when(s.isNull() | (s == ""), F.lit("")).when(scheme.isin("http", "https"), built).otherwise(F.lit(""))
    )
    return df.drop(*[c for c in df.columns if c.startswith(t)])


# ------------------------------------------------------------------ U4 U5 U8 U10


def root_domain(host) -> Column:
    """U4: last two dot-separated labels, lower-cased ('' for '')."""
    return F.substring_index(F.lower(F.coalesce(col(host), F.lit(""))), ".", -2)


def with_host_path(df: DataFrame, url: str, root: Column | None = None, host_out="host", path_out="path") -> DataFrame:
    """host = hostname, else the crawl's root domain, else ''; path = path or '/', plus '?query'."""
    t = _tmp()
    df = with_url_parts(df, url, t)
    fallback = [nonempty(root)] if root is not None else []
    path = F.coalesce(nonempty(t + "path"), F.lit("/"))
    df = df.withColumns(
        {
            host_out: F.coalesce(nonempty(t + "host"), *fallback, F.lit("")),
            path_out: F.when(F.col(t + "query") != "", F.concat(path, F.lit("?"), F.col(t + "query"))).otherwise(path),
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith(t)])


def export_file_name(host, title, path, url) -> Column:
    """U8: ``{host}__{slug(title or path or url)}.md`` (duplicates are not resolved)."""
    return F.concat(
        F.coalesce(col(host), F.lit("")), F.lit("__"), slugify(first_nonempty(title, path, url), "page"), F.lit(".md")
    )


# ------------------------------------------------------------------ P1 P2 U6


def _ipv4_value(h: Column) -> Column:
    """BIGINT of a strict dotted quad (no leading zeros, each 0..255), else NULL."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
    pat = rf"^{octet}\.{octet}\.{octet}\.{octet}\z"
    parts = [F.regexp_extract(h, pat, i).cast("bigint") for i in range(1, 5)]
    value = parts[0] * (1 << 24) + parts[1] * (1 << 16) + parts[2] * (1 << 8) + parts[3]
    return F.when(h.rlike(pat), value)


def _ipv4_private(v: Column) -> Column:
    cond = F.lit(False)
    for lo, hi in _IPV4_PRIVATE:
        cond = cond | v.between(_ip_int(lo), _ip_int(hi))
    return cond & ~v.isin(*[_ip_int(x) for x in _IPV4_EXCEPTIONS])


def _with_ipv6_hextets(df: DataFrame, h: str, out: str) -> DataFrame:
    """``out`` = array<int> of 8 hextets for a valid IPv6 literal (zone removed), else NULL."""
    t = _tmp()
    df = df.withColumn(t + "h", F.regexp_extract(h, r"^([^%]*)", 1))
    df = df.withColumn(t + "t", F.regexp_extract(t + "h", r"(?:^|:)(\d+\.\d+\.\d+\.\d+)\z", 1))
    df = df.withColumn(t + "v4", _ipv4_value(F.col(t + "t")))
    v4 = F.col(t + "v4")
    tail_hex = F.concat(F.lower(F.hex(F.floor(v4 / 65536))), F.lit(":"), F.lower(F.hex(v4 % 65536)))
    hh, tt = F.col(t + "h"), F.col(t + "t")
    df = df.withColumn(
        t + "b", F.when(tt != "", F.concat(F.substring(hh, F.lit(1), F.length(hh) - F.length(tt)), tail_hex)).otherwise(hh)
    )
    b = F.col(t + "b")
    df = df.withColumns(
        {
            t + "d": F.size(F.split(b, "::", -1)) - 1,
            t + "l": F.filter(F.split(F.regexp_extract(b, r"^(.*?)(?:::|\z)", 1), ":", -1), lambda x: x != ""),
            t + "r": F.filter(F.split(F.regexp_extract(b, r"::(.*)\z", 1), ":", -1), lambda x: x != ""),
        }
    )
    d, left, right = F.col(t + "d"), F.col(t + "l"), F.col(t + "r")
    missing = 8 - F.size(left) - F.size(right)
    df = df.withColumns(
        {
            t + "g": F.when(d == 1, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)).otherwise(
                F.split(b, ":", -1)
            ),
            t + "m": missing,
        }
    )
    g = F.col(t + "g")
    valid = (
        hh.rlike(r"^[0-9A-Fa-f:.]+\z")
        & hh.contains(":")
        & ~hh.contains(":::")
        & (~hh.startswith(":") | hh.startswith("::"))
        & (~hh.endswith(":") | hh.endswith("::"))
        & (d <= 1)
        & ((tt == "") | v4.isNotNull())
        & (F.size(g) == 8)
        & F.forall(g, lambda x: x.rlike(r"^[0-9A-Fa-f]{1,4}\z"))
        & (((d == 1) & (F.col(t + "m") >= 1)) | (d == 0))
    )
    df = df.withColumn(out, F.when(valid, F.transform(g, lambda x: F.conv(x, 16, 10).cast("int"))))
    return df.drop(*[c for c in df.columns if c.startswith(t)])


def _ipv6_blocked(x: Column) -> Column:
    g = [x[i] for i in range(8)]

    def zeros(idx):
        cond = F.lit(True)
        for i in idx:
            cond = cond & (g[i] == 0)
        return cond

    mapped = zeros(range(5)) & (g[5] == 0xFFFF)
    v4 = g[6].cast("bigint") * 65536 + g[7]
    loop_or_unspec = zeros(range(7)) & g[7].isin(0, 1)
    n2001 = (g[0] == 0x2001) & (g[1] < 0x200)
    n2001_exc = (
        ((g[1] == 1) & zeros(range(2, 7)) & g[7].isin(1, 2))
        | (g[1] == 3)
        | ((g[1] == 4) & (g[2] == 0x112))
        | g[1].between(0x20, 0x3F)
    )
    other = (
        ((g[0] == 0x64) & (g[1] == 0xFF9B) & (g[2] == 1))
        | ((g[0] == 0x100) & zeros([1, 2, 3]))
        | (n2001 & ~n2001_exc)
        | ((g[0] == 0x2001) & (g[1] == 0xDB8))
        | (g[0] == 0x2002)
        | g[0].between(0xFC00, 0xFDFF)
        | g[0].between(0xFE80, 0xFEBF)
    )
    return F.when(mapped, _ipv4_private(v4)).otherwise(loop_or_unspec | other)


def with_ip_blocked(df: DataFrame, host: str, out: str) -> DataFrame:
    """``out`` = host is an IP literal that is private, loopback or link-local (CPython 3.13)."""
    t = _tmp()
    df = df.withColumn(t + "h", F.lower(F.coalesce(F.col(host), F.lit(""))))
    df = df.withColumn(t + "v4", _ipv4_value(F.col(t + "h")))
    df = _with_ipv6_hextets(df, t + "h", t + "v6")
    v6 = F.col(t + "v6")
    df = df.withColumn(
        out,
        F.coalesce(_ipv4_private(F.col(t + "v4")), F.lit(False))
        | F.coalesce(F.when(v6.isNotNull(), _ipv6_blocked(v6)), F.lit(False)),
    )
    return df.drop(t + "h", t + "v4", t + "v6")


def with_blocked_host(df: DataFrame, host: str, out: str) -> DataFrame:
    """Localhost, 127.0.0.1, ::1, or a private / loopback / link-local IP literal."""
    t = _tmp()
    df = with_ip_blocked(df, host, t + "ip")
    df = df.withColumn(out, F.lower(F.coalesce(F.col(host), F.lit(""))).isin(*BLOCKED_NAMES) | F.col(t + "ip"))
    return df.drop(t + "ip")


def with_blocked_url(df: DataFrame, url: str, out: str) -> DataFrame:
    """Scheme other than http(s), or P1 on the hostname."""
    t = _tmp()
    df = with_url_parts(df, url, t)
    df = with_blocked_host(df, t + "host", t + "b")
    df = df.withColumn(out, ~F.col(t + "scheme").isin("http", "https") | F.col(t + "b"))
    return df.drop(*[c for c in df.columns if c.startswith(t)])


def with_public_url(df: DataFrame, url: str, out_url: str = "safe_url", out_reason: str = "reject_reason") -> DataFrame:
    """U6 ``_ensure_public_url``: accepted URL (``geturl()`` of the https-defaulted parse) or
    NULL plus the rejection message."""
    t = _tmp()
    df = df.withColumn(
        t + "u",
        F.when(clean_url(url).rlike(_SCHEME), F.col(url)).otherwise(F.concat(F.lit("https://"), F.col(url))),
    )
    df = with_url_parts(df, t + "u", t)
    df = with_ip_blocked(df, t + "host", t + "ip")
    reason = (
        F.when(~F.col(t + "scheme").isin("http", "https"), F.lit("Only http(s) URLs are allowed."))
        .when(F.col(t + "ip") | (F.col(t + "host") == "localhost"), F.lit("Target host is not allowed."))
        .otherwise(F.lit(""))
    )
    params = F.col(t + "params")
    df = df.withColumns(
        {
            t + "pp": F.when(params != "", F.concat(F.col(t + "path"), F.lit(";"), params)).otherwise(F.col(t + "path")),
            out_reason: reason,
        }
    )
    geturl = _unsplit(F.col(t + "scheme"), F.col(t + "netloc"), F.col(t + "pp"), F.col(t + "query"))
    frag = F.col(t + "fragment")
    geturl = F.when(frag != "", F.concat(geturl, F.lit("#"), frag)).otherwise(geturl)
    df = df.withColumn(out_url, F.when(F.col(out_reason) == "", geturl))
    return df.drop(*[c for c in df.columns if c.startswith(t)])


# ------------------------------------------------------------------ P3 P4 P5


def with_internal(
    df: DataFrame,
    url: str,
    start_host: str,
    root: str,
    out: str,
    allowed_hosts: Sequence[str] = (),
    include_subdomains: bool = False,
) -> DataFrame:
    """P3 in the service's order; ``start_host`` / ``root`` are columns (one crawl per seed)."""
    t = _tmp()
    df = with_url_parts(df, url, t)
    df = with_blocked_host(df, t + "host", t + "b")
    h = F.col(t + "host")
    cond = (
        F.when(~F.col(t + "scheme").isin("", "http", "https"), F.lit(False))
        .when(F.col(t + "b"), F.lit(False))
        .when(h == "", F.lit(True))
        .when(h == F.lower(F.col(start_host)), F.lit(True))
    )
    if allowed_hosts:
        allowed = F.lit(False)
        for a in allowed_hosts:
            allowed = allowed | (h == a) | h.endswith("." + a)
        cond = cond.otherwise(allowed)
    else:
        cond = cond.when(h == F.col(root), F.lit(True))
        if include_subdomains:
            cond = cond.when(h.endswith(F.concat(F.lit("."), F.col(root))), F.lit(True))
        cond = cond.otherwise(F.lit(False))
    df = df.withColumn(out, cond)
    return df.drop(*[c for c in df.columns if c.startswith(t)])


def with_path_prefix_match(df: DataFrame, url: str, out: str, prefixes: Sequence[str] = ()) -> DataFrame:
    """No prefixes -> True; else ``path[?query]`` starts with one of them."""
    if not prefixes:
        return df.withColumn(out, F.lit(True))
    t = _tmp()
    df = with_host_path(df, url, None, t + "h", t + "pq")
    pq = F.col(t + "pq")
    cond = F.lit(False)
    for pre in prefixes:
        cond = cond | pq.startswith(pre)
    return df.withColumn(out, cond).drop(t + "h", t + "pq")


def ignored_extension(path) -> Column:
    """P5 on a path column: the lower-cased path ends with one of the 16 ignored extensions."""
    p = F.lower(col(path))
    cond = F.lit(False)
    for e in IGNORED_EXTENSIONS:
        cond = cond | p.endswith(e)
    return cond


def with_ignored_extension(df: DataFrame, url: str, out: str) -> DataFrame:
    t = _tmp()
    df = with_url_parts(df, url, t)
    df = df.withColumn(out, ignored_extension(t + "path"))
    return df.drop(*[c for c in df.columns if c.startswith(t)])


# ------------------------------------------------------------------ U3


# Schemes that resolve relative references (Python's uses_relative).
USES_RELATIVE = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)
USES_NETLOC = (
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
    "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
    "git+ssh", "ws", "wss", "itms-services",
)


def _resolve_dots(segments: Column) -> Column:
    empty = F.array().cast("array<string>")
    resolved = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)


def with_urljoin(df: DataFrame, base: str, href: str, out: str) -> DataFrame:
    """``urljoin(base, href)`` (RFC 3986 merge and dot-segment removal as Python does it)."""
    t = _tmp()
    df = with_url_parts(df, base, t + "b_")
    df = with_url_parts(df, href, t + "h_")
    df = with_joined_parts(df, base, href, out, t + "b_", t + "h_")
    return df.drop(*[c for c in df.columns if c.startswith(t)])


def with_joined_parts(df: DataFrame, base: str, href: str, out: str, base_parts: str, href_parts: str) -> DataFrame:
    """``with_urljoin`` for URLs that are split already, into columns with the given prefixes."""
    t = _tmp()
    b = lambda k: F.col(f"{base_parts}{k}")
    h = lambda k: F.col(f"{href_parts}{k}")
    df = df.withColumn(t + "s", F.when(h("scheme") != "", h("scheme")).otherwise(b("scheme")))
    s = F.col(t + "s")
    folder = F.split(b("path"), "/", -1)
    df = df.withColumn(t + "rel", F.concat(F.when(F.element_at(folder, -1) != "", F.slice(folder, 1, F.size(folder) - 1)).otherwise(folder), F.split(h("path"), "/", -1)))
    rel, n = F.col(t + "rel"), F.size(t + "rel")
    inner = F.filter(F.slice(rel, 2, F.greatest(n - 2, F.lit(1))), lambda x: x != "")
    rel = F.when(n > 2, F.concat(F.slice(rel, 1, 1), inner, F.slice(rel, -1, 1))).otherwise(rel)
    df = df.withColumn(t + "segs", F.when(h("path").startswith("/"), F.split(h("path"), "/", -1)).otherwise(rel))
    merged = F.coalesce(nonempty(F.array_join(_resolve_dots(F.col(t + "segs")), "/")), F.lit("/"))
    # each part of the result is chosen once: the reference's own from its host on, or the base's as far as it is silent
    df = df.withColumn(t + "own", s.isin(*USES_NETLOC) & (h("netloc") != ""))
    df = df.withColumn(t + "silent", ~F.col(t + "own") & (h("path") == "") & (h("params") == ""))
    own, silent = F.col(t + "own"), F.col(t + "silent")
    df = df.withColumns({
        t + "netloc": F.when(own, h("netloc")).otherwise(b("netloc")),
        t + "path": F.when(own, h("path")).when(silent, b("path")).otherwise(merged),
        t + "params": F.when(silent, b("params")).otherwise(h("params")),
        t + "query": F.when(silent & (h("query") == ""), b("query")).otherwise(h("query")),
    })
    params = F.col(t + "params")
    path = F.when(params != "", F.concat(F.col(t + "path"), F.lit(";"), params)).otherwise(F.col(t + "path"))
    df = df.withColumn(t + "url", _unsplit(s, F.col(t + "netloc"), path, F.col(t + "query")))
    url = F.when(h("fragment") != "", F.concat(F.col(t + "url"), F.lit("#"), h("fragment"))).otherwise(F.col(t + "url"))
    joined = F.when((s != b("scheme")) | ~s.isin(*USES_RELATIVE), F.col(href)).otherwise(url)
    src_b, src_h = F.col(base), F.col(href)
    df = df.withColumn(
        out,
        F.when(F.coalesce(src_b, F.lit("")) == "", src_h).when(F.coalesce(src_h, F.lit("")) == "", src_b).otherwise(joined),
    )
    return df.drop(*[c for c in df.columns if c.startswith(t)])
