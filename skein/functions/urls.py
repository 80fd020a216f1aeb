"""URL algebra as column expressions. Unparsable URLs give null, or what each function's docstring says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of files that are not pages, and path segments that trap a crawler.
FILE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico", "pdf", "zip", "tar", "gz", "7z", "mp3", "wav", "ogg", "mp4", "webm", "mov", "avi", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
TRAP_SEGMENTS = ("login", "logout", "signin", "signout", "sign-in", "sign-out", "sign_in", "sign_out", "signup", "sign-up", "sign_up", "register", "search", "calendar")

#: Scheme, user, host, port (up to 65535, without leading zeros) and path of a tidy URL.
PORT = "[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]"
PATTERN = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^/?#]*)@)?(\[[0-9a-fA-F:.]+\]|[^\x00-\x20/?#@:<>\[\]^|%\\\x7F]*)(?::(?:0*(?=[0-9]))?(" + PORT + r")?)?((?:/[^?#]*)?)(?=[?#]|$)"
#: URLs of these schemes have a host, whatever slashes come before it, and take backslashes for slashes.
WITH_HOST = "(?i)^(https?|wss?|ftp):"
DEFAULT_PORT = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def let(value: Column, then) -> Column:
    """then(value), with value made once however often then refers to it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tidy(url: Column) -> Column:
    """url without blanks around it and line breaks in it; if its scheme has a host, with // before that and no backslash up to the query."""
    plain = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    slashes = F.regexp_replace(plain, r"\G([^?#\\]*)\\", "$1/")
    hosted = F.regexp_replace(slashes, WITH_HOST + "/*", "$1://")
    odd = r"^[\x00-\x20]|[\x00-\x20]$|[\t\n\r\\]|" + WITH_HOST + "(?!//[^/])"
    return F.when(url.rlike(odd), F.when(plain.rlike(WITH_HOST), hosted).otherwise(plain)).otherwise(url)


def _group(tidy_url: Column, n: int) -> Column:
    return F.regexp_extract(tidy_url, PATTERN, n)


def _scheme(u: Column) -> Column:
    return F.nullif(F.lower(_group(u, 1)), F.lit(""))


def _host(u: Column) -> Column:
    return F.nullif(F.lower(_group(u, 3)), F.lit(""))


def _port(u: Column) -> Column:
    given, usual = F.nullif(_group(u, 4), F.lit("")), F.create_map(*[F.lit(x) for kv in DEFAULT_PORT.items() for x in kv])
    return F.when(given != F.coalesce(F.try_element_at(usual, _scheme(u)), F.lit("")), given)


def scheme(url: Column) -> Column:
    return let(tidy(url), _scheme)


def host(url: Column) -> Column:
    """The host in lower case, names beyond ASCII as they are written; null if it has a character that no host may have,
    a percent code included, or if the port is no number up to 65535."""
    return let(tidy(url), _host)


def port(url: Column) -> Column:
    """The port as text, null if none is given or if it is the scheme's default."""
    return let(tidy(url), _port)


def parses(url: Column) -> Column:
    return F.coalesce(host(url).isNotNull(), F.lit(False))


def percent_encode(path: Column) -> Column:
    """Characters that may not stand in a path as the percent codes of their UTF-8 bytes."""
    odd = r"[^\x21-\x7E]|[\"<>`{}]"
    code = lambda c: F.when(c.rlike(odd), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    return F.when(path.rlike(odd), F.array_join(F.transform(F.split(path, ""), code), "")).otherwise(path)


def without_dots(path: Column) -> Column:
    """The path with . and .. segments resolved."""
    start = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        parent = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.when(part.rlike(r"(?i)^(?:\.|%2e){2}$"), parent).when(part.rlike(r"(?i)^(?:\.|%2e)$"), kept).otherwise(F.concat(kept, F.array(part)))

    done = F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
    done = F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}$"), F.regexp_replace(done, "/?$", "/")).otherwise(done)
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(/|$)"), done).otherwise(path)


def _path(u: Column) -> Column:
    plain = let(_group(u, 5), lambda p: F.when(p == "", F.lit("/")).otherwise(without_dots(p)))
    return let(plain, percent_encode)


def path(url: Column) -> Column:
    """The path, / if it is empty; . and .. are resolved, written as %2e too."""
    return let(tidy(url), _path)


def normalize(url: Column) -> Column:
    """scheme://[user@]host[:port]/path of an http(s) URL, without query, fragment and default port; null otherwise."""
    return let(tidy(url), _normal)


def _normal(u: Column) -> Column:
    user = F.replace(F.nullif(_group(u, 2), F.lit("")), F.lit("@"), F.lit("%40"))
    out = F.concat(_scheme(u), F.lit("://"), F.coalesce(F.concat(user, F.lit("@")), F.lit("")), _host(u), F.coalesce(F.concat(F.lit(":"), _port(u)), F.lit("")), _path(u))
    return F.when(_scheme(u).isin("http", "https") & _host(u).isNotNull(), out)


def origin(url: Column) -> Column:
    """scheme://host[:port], the port only where it is not the default."""
    return let(tidy(url), lambda u: F.concat(_scheme(u), F.lit("://"), _host(u), F.coalesce(F.concat(F.lit(":"), _port(u)), F.lit(""))))


def same_origin(a: Column, b: Column) -> Column:
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def is_file(url: Column) -> Column:
    """Whether the last path segment has one of FILE_EXTENSIONS; false for an unparsable URL."""
    return F.coalesce(parses(url) & F.lower(F.regexp_extract(path(url), r"\.([^./]*)$", 1)).isin(*FILE_EXTENSIONS), F.lit(False))


def is_searchable(url: Column) -> Column:
    return ~is_file(url)


def path_depth(url: Column) -> Column:
    """The number of path segments that are not empty; 0 for an unparsable URL."""
    return F.when(parses(url), F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))).otherwise(0).cast("long")


def is_domain_root(url: Column) -> Column:
    return path_depth(url) == 0


def normalize_host(name: Column) -> Column:
    """Trimmed, without trailing dots and one lower-case www., then lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"\.+$", ""), r"^www\.", ""))


def is_crawl_trap(url: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path(url)), "/"), F.array(*[F.lit(x) for x in TRAP_SEGMENTS]))


def resolve(base: Column, href: Column) -> Column:
    """href as an absolute URL, seen from base."""
    h = F.regexp_replace(F.regexp_replace(F.btrim(href), r"[\t\n\r]", ""), r"\G([^?#\\]*)\\", "$1/")
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    whole = F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h)).when(h.startswith("/"), F.concat(origin(base), h))
    return whole.when((h == "") | h.rlike("^[?#]"), F.concat(origin(base), path(base), h)).otherwise(F.concat(origin(base), folder, h))


def is_link(href: Column) -> Column:
    """Whether an href may lead to a page at all."""
    h, no = F.btrim(href), F.lit(False)
    for start in ("javascript:", "mailto:", "tel:", "data:"):
        no = no | h.startswith(start)
    return (h != "") & ~no


def diversity_host(url: Column) -> Column:
    """The host, or the whole text of a URL that has none."""
    return F.coalesce(host(url), url)


def bulk_domain(url: Column) -> Column:
    """The network location, lower-cased, with port and user; empty if there is none."""
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def url_bytes(url: Column) -> Column:
    return F.greatest(F.octet_length(url), F.lit(1)).cast("long")


def skip_reason(url: Column, skip_domains: list[str], skip_patterns: list[str]) -> Column:
    """Why a seed is not submitted, null if it is: rules in order, first hit wins."""
    domain, low = bulk_domain(url), F.lower(url)
    out = F.when(domain == "", "invalid URL")
    for d in skip_domains:
        out = out.when(domain.contains(d) | F.contains(F.lit(d), domain), f"domain '{d}' in skip list")
    for p in skip_patterns:
        out = out.when(low.contains(p), f"matches skip pattern '{p}'")
    return out.when(~url.rlike("^https?://"), "not HTTP/HTTPS")


def needs_browser(url: Column, browser_domains: list[str]) -> Column:
    found = F.lit(False)
    for d in browser_domains:
        found = found | bulk_domain(url).contains(d)
    return found
