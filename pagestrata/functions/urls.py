"""URL functions: canonical form, resolution, exclusion, page type, routes and addresses.

A URL is split once into text parts and rebuilt, so every step is a built-in
expression; the rules are those of the public URL standard for http(s).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.functions.text import clean_text, let, record

_SCHEME = r"\A[A-Za-z][A-Za-z0-9+.\-]*:"
_WEB = ["http", "https"]
# Edge between an ASCII word character and anything else.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


# [scheme, user, host, port, path, query] of an absolute URL, in one pass.
_ABSOLUTE = (
    r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?#@]*@)?(\[[^\]]*\]|[^/\\?#:]*)(?::0*([0-9]*))?"
    r"([/\\][^?#]*)?(\?[^#]*)?(#.*)?\z"
)
_PARTS = "\u0001".join(f"${n}" for n in range(1, 7))
_PATH_SAFE = r"\A[!$%&\x27()*+,\-./0-9:;=@A-Z\[\]^_a-z|~]*\z"
_DOTS = r"(?i)/(\.|%2e){1,2}(/|\z)"

# Dot segments are resolved from the left, then characters a path cannot hold are encoded as UTF-8.
_HARD_PATH = rf"""array_join(transform(split(
    array_join(aggregate(split(replace(p[4], r'\', '/'), '/'), cast(array() as array<string>), (done, s) -> case
        when s rlike r'(?i)\A(\.|%2e){{2}}\z' then slice(done, 1, greatest(size(done) - 1, 1))
        when s rlike r'(?i)\A(\.|%2e)\z' then done else concat(done, array(s)) end), '/'), ''),
    c -> case when c rlike r'{_PATH_SAFE}' then c when c = ' ' then '%20' else url_encode(c) end), '')"""
# Query pairs are decoded and encoded again the way a form is sent (stray percent signs are text);
# tracking parameters go, and the rest is sorted by name, in its own order among equal names.
_FORM = "url_encode(url_decode(regexp_replace({0}, r'%(?![0-9A-Fa-f]{{2}})', '%25')))"
_QUERY = f"""array_join(transform(array_sort(filter(
    transform(filter(split(substring(p[5], 2), '&'), q -> q != ''), (q, i) -> named_struct(
        'name', {_FORM.format("substring_index(q, '=', 1)")}, 'at', i,
        'value', {_FORM.format(r"if(instr(q, '=') > 0, regexp_replace(q, r'\A[^=]*=', ''), '')")})),
    q -> not startswith(lower(q.name), '{C.TRACKING_PREFIX}')
        and lower(q.name) not in ({", ".join(f"'{t}'" for t in C.TRACKING_PARAMETERS)}))),
    q -> concat(q.name, '=', q.value)), '&')"""
# The canonical form of the parts as SQL text: one lambda without further ones around it, because
# nested lambdas make the types of the outer ones expensive to look up.
_CANONICAL = rf"""p -> case
    when size(p) < 6 then null
    when lower(p[0]) not in ('http', 'https')
        then concat(lower(p[0]), ':', p[1], p[2], if(p[3] = '', '', concat(':', p[3])), p[4], p[5])
    when p[2] = '' or p[2] rlike r'[\x00-\x20%<>@^|]' then null
    else concat(lower(p[0]), '://', p[1], lower(p[2]),
        if(p[3] = '' or (p[3] = '443' and lower(p[0]) = 'https') or (p[3] = '80' and lower(p[0]) = 'http'), '', concat(':', p[3])),
        regexp_replace(regexp_replace(
            if(p[4] rlike r'{_PATH_SAFE}' and not p[4] rlike r'{_DOTS}', p[4], {_HARD_PATH}), r'/+\z', ''), r'\A\z', '/'),
        if(p[5] = '', '', regexp_replace(concat('?', {_QUERY}), r'\A\?\z', ''))) end"""


def ascii_hosts(url: Column) -> Column:
    """URLs with the host name in its ASCII form, on Arrow batches.

    A step for sources with hosts in other scripts; the canonical form itself stays in the JVM and
    leaves such a host as it is, in lower case.
    """
    def host(match: re.Match) -> str:
        try:
            return match.group(1) + match.group(2).encode("idna").decode("ascii")
        except UnicodeError:
            return match.group(0)

    def run(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: None if u is None else re.sub(r"^([A-Za-z][^:]*:/*(?:[^/?#@]*@)?)([^/?#:]+)", host, u))

    return F.pandas_udf(run, "string")(url)


def canonical_url(url: Column) -> Column:
    """The identity of a page: no fragment, lower-case host, no tracking parameters, the other
    parameters sorted by name, no trailing slash except for the root. Invalid input is null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    parts = F.split(F.regexp_replace(bare, _ABSOLUTE, _PARTS), "\u0001")
    return F.get(F.call_function("transform", F.array(parts), F.expr(_CANONICAL)), F.lit(0))


def resolve_url(href: Column, base: Column) -> Column:
    """``href`` as an absolute URL, read relative to the canonical URL ``base``."""
    link = F.regexp_replace(href, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")
    origin = F.regexp_extract(base, r"\A([^:]+://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"\A([^?#]*)", 1)
    folder = F.regexp_replace(url_path(base), r"[^/]*\z", "")
    return (
        F.when(link.rlike(_SCHEME), link)
        .when(link.rlike(r"\A[/\\]{2}"), F.concat(F.substring_index(base, ":", 1), F.lit(":"), link))
        .when(link.rlike(r"\A[/\\]"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when((link == "") | link.startswith("#"), F.concat(F.regexp_extract(base, r"\A([^#]*)", 1), link))
        .otherwise(F.concat(origin, folder, link))
    )


def link_target(href: Column, base: Column) -> Column:
    """Canonical target of a link found on the page ``base``."""
    return canonical_url(resolve_url(href, base))


def url_host(url: Column) -> Column:
    """Host name of a canonical URL, without user and port."""
    authority = F.regexp_extract(url, r"\A[^:]+://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"\A.*@", ""), r":[0-9]*\z", "")


def url_scheme(url: Column) -> Column:
    return F.lower(F.substring_index(url, ":", 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?s)\A[^:]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_query(url: Column) -> Column:
    """The query with its question mark, or empty."""
    return F.regexp_extract(url, r"(?s)\A[^?#]*(\?[^#]*)", 1)


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(url_path(url), "/"), lambda s: s != ""))


def same_host_https(url: Column, host: Column) -> Column:
    return (url_scheme(url) == "https") & (url_host(url) == host)


def same_host_canonical(value: Column, fallback: Column, host: Column) -> Column:
    """The canonical link a page states, if it stays on the host over https; else ``fallback``."""
    stated = link_target(value, fallback)
    return F.when(same_host_https(stated, host), stated).otherwise(fallback)


def exclusion_reason(url: Column) -> Column:
    """Why a page is left out by default, or null."""
    def decide(v: Column) -> Column:
        reason = F
        for pattern, name in C.EXCLUDED_PATHS:
            reason = reason.when(v["path"].rlike("(?i)" + pattern), name)
        reason = reason.when(v["query"].rlike("(?i)" + C.PAGINATION_QUERY), "pagination")
        return reason.when(v["path"].rlike("(?i)" + C.NON_HTML_SUFFIX), "non-html")

    return let(record(path=url_path(url), query=url_query(url)), decide)


def page_type(url: Column, is_homepage: Column, title: Column | None = None, headings: Column | None = None) -> Column:
    """Kind of page by its path, title and headings; the first rule that matches decides."""
    title = F.lit("") if title is None else F.coalesce(title, F.lit(""))
    headings = F.lit("") if headings is None else F.coalesce(F.array_join(headings, " "), F.lit(""))

    def decide(v: Column) -> Column:
        path = v["path"]
        kind = (
            F.when(path.rlike(r"(?i)\A/ai/?\z"), "product")
            .when(path.rlike(r"(?i)/(blog|articles?|insights?|guides?)/."), "article")
            .when(path.rlike(r"(?i)\A/(blog|articles?|insights?|guides?)/?\z"), "resource")
        )
        for name, pattern in C.PAGE_TYPE_WORDS:
            kind = kind.when(v["words"].rlike(pattern.replace(r"\b", _EDGE)), name)
        return kind.otherwise("other")

    words = let(url_path(url), lambda path: record(path=path, words=F.lower(F.concat_ws(" ", path, title, headings))))
    return F.when(is_homepage, "homepage").otherwise(let(words, decide))


def robots_pattern(value: Column) -> Column:
    """A robots path as a regular expression for the start of path and query.

    ``*`` stands for anything; every other character stands for itself, a closing dollar too.
    """
    parts = F.transform(
        F.split(value, r"\*"), lambda p: F.regexp_replace(p, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    )
    return F.concat(F.lit(r"(?s)\A"), F.array_join(parts, ".*"))


def replay_url(stamp: Column, original: Column) -> Column:
    """Where the archive replays the unchanged capture; null if the provenance is broken."""
    valid = stamp.rlike(r"\A[0-9]{14}\z") & original.isNotNull() & (original != "")
    return F.when(
        valid, F.concat(F.lit(f"https://{C.WAYBACK_HOST}/web/"), stamp, F.lit("id_/"), original)
    )


def archived_url(original: Column, host: Column) -> Column:
    """An archived http or https URL of ``host`` as canonical https URL without port; others null."""
    def secure(url: Column) -> Column:
        https = F.regexp_replace(url, r"\A[a-z]+://((?:[^/?#@]*@)?)([^/?#:]*)(:[0-9]+)?", "https://$1$2")
        return F.when(url_scheme(url).isin(_WEB) & (url_host(url) == host), https)

    return let(canonical_url(original), secure)


def file_extension(path: Column) -> Column:
    """Lower-case extension without the dot, or empty."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)\z|[^/]\.([^./]*)\z", 1))


def repository_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A\./", "")


def repository_route(path: Column) -> Column:
    """The page route a repository file renders, or null for files without a static route."""
    clean = repository_path(path)
    extension = file_extension(clean)
    stem = F.regexp_replace(clean, r"\.[^./]*\z", "")
    relative = (
        F.when(stem.rlike(r"\A(?:src/)?app/.*/page\z"), F.regexp_extract(stem, r"\A(?:src/)?app/(.*)/page\z", 1))
        .when(stem.rlike(r"\A(?:src/)?app/page\z"), "")
        .when(stem.rlike(r"\A(?:src/)?pages/"), F.regexp_extract(stem, r"\A(?:src/)?pages/(.*)\z", 1))
        .when(extension.isin("html", "htm"), F.regexp_replace(stem, r"\A(?:out|dist|build|public|static)/", ""))
    )
    relative = F.regexp_replace(F.regexp_replace(relative, r"(^|/)index\z", ""), r"(^|/)page\z", "")
    private = relative.rlike(r"\A_") | relative.rlike(r"(^|/)_(app|document|error)\z")
    # Groups in parentheses and slots leave no trace in the route.
    visible = F.filter(
        F.split(relative, "/"), lambda s: (s != "") & ~s.rlike(r"\A\(.+\)\z") & ~s.startswith("@")
    )
    dynamic = F.exists(visible, lambda s: s.rlike(r"[\[\]*]|\A\$"))
    route = F.concat(F.lit("/"), F.array_join(visible, "/"))
    return F.when(extension.isin(C.ROUTE_EXTENSIONS) & relative.isNotNull() & ~private & ~dynamic, route)


def is_navigation_source(path: Column) -> Column:
    named = path.rlike(r"(?i)(^|/)(nav|navbar|navigation|header|menu|layout)(\.|/)")
    return named & file_extension(path).isin(C.ROUTE_EXTENSIONS)


def is_private_address(address: Column) -> Column:
    """True for addresses that must never be fetched, and for anything that is no address."""
    plain = F.substring_index(F.lower(address), "%", 1)
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4 = rf"(?:{octet}\.){{3}}{octet}"
    dotted = F.when(plain.rlike(rf"\A{v4}\z"), plain).when(
        plain.rlike(rf"\A::ffff:{v4}\z"), F.substring(plain, 8, 20)
    )
    a = F.split(dotted, r"\.")[0].cast("int")
    b = F.split(dotted, r"\.")[1].cast("int")
    private_v4 = (
        a.isin(0, 10, 127)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 198) & b.isin(18, 19))
        | (a >= 224)
    )
    looks_v6 = plain.rlike(r"\A[0-9a-f:]*:[0-9a-f:]*\z") & plain.rlike(r":.*:")
    private_v6 = plain.isin("::", "::1") | plain.rlike(r"\A(fc|fd|fe8|fe9|fea|feb)")
    return F.coalesce(F.when(dotted.isNotNull(), private_v4).when(looks_v6, private_v6), F.lit(True))


def is_public_url(url: Column, https_only: bool = False) -> Column:
    """The part of the fetch policy that needs no name lookup: scheme, local names, literal addresses."""
    host = url_host(url)
    local = (host == "localhost") | host.endswith(".localhost")
    literal = F.regexp_replace(host, r"\A\[|\]\z", "")
    is_literal = literal.rlike(r"\A[0-9.]+\z") | literal.contains(":")
    schemes = ["https"] if https_only else _WEB
    return F.coalesce(
        url_scheme(url).isin(schemes) & (host != "") & ~local & ~(is_literal & is_private_address(literal)),
        F.lit(False),
    )


def file_name_in(folder_path: Column, name: Column) -> Column:
    """``name`` inside its folder as a normal path, or null if it would leave the folder."""
    joined = F.concat(folder_path, F.lit("/"), clean_text(name))
    leaves = name.rlike(r"(^|/)\.\.(/|$)") | name.startswith("/")
    return F.when(~leaves, F.regexp_replace(joined, r"/(\./)*", "/"))
