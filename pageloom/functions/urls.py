"""URL rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pageloom.functions.sqltext import bind
from pageloom.functions.text import empty_to_null

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def extract_url(query: Column) -> Column:
    """First http(s) URL in a sentence without trailing ``. , )``; null when there is none."""
    found = F.regexp_extract(query, "(?U)https?://[^\\s\"']+", 0)
    return empty_to_null(F.regexp_replace(found, r"[.,)]+$", ""))


def normalise_url(url: Column) -> Column:
    """Add ``https://`` when no scheme is present, drop all trailing slashes."""
    full = F.when(url.rlike(_SCHEME), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(full, r"/+$", "")


def authority(url: Column) -> Column:
    """Host with port as written; empty when the URL has none. Never throws, unlike parse_url."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def same_domain(a: Column, b: Column) -> Column:
    """U4: exact authority equality (case, port and ``www.`` count)."""
    return authority(a) == authority(b)


def strip_fragment(url: Column) -> Column:
    """Cut from the first ``#``."""
    return F.regexp_replace(url, r"(?d)#.*$", "")


def base_sql(url: str) -> str:
    """Parts of a base address: scheme, host, path, query, and the address itself."""
    return (f"struct({url} as base, lower(regexp_extract({url}, r'^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, "
            f"regexp_extract({url}, r'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) as host, "
            f"regexp_extract({url}, r'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) as path, "
            f"regexp_extract({url}, r'^[^?#]*(\\?[^#]*)?', 1) as query)")


def _merge_path_sql(base_path: str, path: str) -> str:
    """Path of a relative or root-relative reference against the base path, dot segments folded."""
    folded = ("aggregate(split(j, '/', -1), cast(array() as array<string>), (acc, s) -> case s "
              "when '..' then slice(acc, 1, greatest(size(acc) - 1, 0)) when '.' then acc else concat(acc, array(s)) end)")
    folded_path = (f"array_join(concat({folded}, if(element_at(split(j, '/', -1), -1) in ('.', '..'), array(''), "
                   f"cast(array() as array<string>))), '/')")
    # a relative reference also loses doubled slashes inside the joined path
    joined = (f"if(startswith({path}, '/'), {path}, regexp_replace(concat("
              f"coalesce(nullif(regexp_replace({base_path}, r'[^/]*$', ''), ''), '/'), {path}), '/{{2,}}', '/'))")
    dotted = "(contains(j, '/.') or startswith(j, '.'))"
    return bind(joined, "j", bind(f"if({dotted}, {folded_path}, j)", "f", "if(startswith(f, '/'), f, concat('/', f))"))


def resolve_sql(base: str, href: str) -> str:
    """Absolute form of ``href`` against the parts of ``base_sql`` (RFC 3986 rules)."""
    root = f"concat({base}.scheme, '://', {base}.host"
    scheme = f"if(contains(r, ':'), lower(regexp_extract(r, r'^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '')"
    rest = f"if(s = {base}.scheme and s <> '', substring(r, length(s) + 2), r)"
    path, tail = "regexp_extract(t, r'^[^?#]*', 0)", "regexp_extract(t, r'(?s)^[^?#]*(.*)$', 1)"
    resolved = (f"case when startswith(t, '//') then concat({base}.scheme, ':', t) "
                f"when startswith(t, '/') and not contains(t, '/.') then {root}, t) "
                f"when {path} = '' then {root}, {base}.path, if(startswith({tail}, '?'), {tail}, concat({base}.query, {tail}))) "
                f"else {root}, {_merge_path_sql(f'{base}.path', path)}, {tail}) end")
    # an empty query is no query
    trimmed = f"if(contains(t0, '?'), regexp_replace(t0, r'^([^?#]*)\\?(?=#|$)', '$1'), t0)"
    inner = bind(rest, "t0", bind(trimmed, "t", resolved))
    chosen = bind(scheme, "s", f"if((s <> '' and s <> {base}.scheme) or {base}.scheme = '', r, {inner})")
    return bind(f"translate({href}, '\\t\\r\\n', '')", "r", f"if(r = '', {base}.base, {chosen})")


def resolve_href(base: str, href: str) -> Column:
    """Absolute form of a reference found on page ``base``; both are SQL expressions."""
    return F.expr(bind(base_sql(base), "base_parts", resolve_sql("base_parts", href)))


def url_slug(url: Column) -> Column:
    """File key of a page: up to 50 readable characters (non-word ones as ``_``, none outside) and a
    digest of the whole URL, so long URLs with the same start keep different keys."""
    readable = F.btrim(F.substring(F.regexp_replace(url, r"(?U)[^\w]", "_"), 1, 50), F.lit("_"))
    return F.concat(readable, F.lit("_"), F.substring(F.sha2(url, 256), 1, 16))
