"""Mail addresses, URLs and user agents."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftql.functions import function
from siftql.functions.text import filled
from siftql.plans.values import BOOL, STR, CompileProblem, Val, to_str

LIST, MAP = T.ArrayType(STR), T.MapType(STR, STR)
ADDRESS = r"""^\s*(?:"?([^"<>@]*?)"?\s*<\s*([^\s<>@,;]+@[^\s<>@,;]+)\s*>|([^\s<>@,;"]+@[^\s<>@,;"]+))\s*$"""


def _address(x):
    s = to_str(x)
    got = F.concat(F.regexp_extract(s, ADDRESS, 2), F.regexp_extract(s, ADDRESS, 3))
    return F.nullif(F.lower(got), F.lit(""))


@function("email")
def email(c, x):
    return Val(_address(x), STR)


@function("emailname")
def email_name(c, x):
    return Val(F.nullif(F.trim(F.regexp_extract(to_str(x), ADDRESS, 1)), F.lit("")), STR)


@function("emaildomain")
def email_domain(c, x):
    return Val(F.nullif(F.regexp_extract(_address(x), "@(.+)$", 1), F.lit("")), STR)


@function("email_is_valid")
def email_is_valid(c, x):
    return Val(F.coalesce(to_str(x).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False)), BOOL)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


#: No host has these.
BAD_HOST = r"[\s%\"<>\\^`{|}]"


def _schemed(s):
    return F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), s).otherwise(F.concat(F.lit("http://"), s))


def _url(s):
    """The part before a fragment, with blanks escaped, so that one bad character does not lose the rest."""
    return F.regexp_replace(F.regexp_replace(_schemed(s), r"[\s\"<>\\^`{|}]", "%20"), r"%(?![0-9A-Fa-f]{2})", "%25")


def _host(s):
    got = F.nullif(F.lower(F.regexp_extract(_schemed(s), HOST, 1)), F.lit(""))
    return F.when(~got.rlike(BAD_HOST), got)


def _domain(s):
    parts = F.split(_host(s), r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "."))


#: Shorter texts are no URL with a host.
LEAST_HOST = 8


@function("host")
def host(c, x):
    s = to_str(x)
    return Val(F.when(F.length(s) >= LEAST_HOST, _host(s)), STR)


@function("domain")
def domain(c, x):
    return Val(_domain(to_str(x)), STR)


def _many(name, build, least):
    @function(name, most=None)
    def made(c, *xs):
        arrays = [F.coalesce(x.col.cast("array<string>"), F.array().cast("array<string>")) if x.kind == "array" else F.array(to_str(x)) for x in xs]
        got = F.transform(F.concat(*arrays), lambda u: F.when(F.length(u) >= least, build(u)))
        found = F.array_distinct(F.filter(got, lambda u: u.isNotNull()))
        return Val(F.when(F.size(found) > 0, found), LIST)


_many("domains", _domain, 4)
_many("hosts", _host, LEAST_HOST)


def _path(s):
    """Texts that begin with neither http nor a slash are taken to follow ``http://``, another scheme included."""
    s = F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") & ~s.startswith("http"), F.concat(F.lit("http://"), s)).otherwise(s)
    got = F.regexp_extract(_schemed(s), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(~F.regexp_extract(_schemed(s), HOST, 1).rlike(BAD_HOST), got)


@function("path")
def path(c, x):
    return Val(F.lower(_path(to_str(x))), STR)


@function("urlmain")
def url_main(c, x):
    s = to_str(x)
    place = F.regexp_extract(F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?", ""), r"^([^?#]*)", 1)
    return Val(F.when(~F.regexp_extract(place, "^([^/]*)", 1).rlike(BAD_HOST), F.nullif(place, F.lit(""))), STR)


def _query(s, key):
    raw = F.when(key.rlike(r"^[\w.-]+$"), F.call_function("regexp_extract", F.regexp_replace(s, "#.*$", ""), F.concat(F.lit("[?&]"), key, F.lit("=([^&]*)")), F.lit(1)))
    return F.nullif(F.try_url_decode(F.regexp_replace(raw, r"%(?![0-9A-Fa-f]{2})", "%25")), F.lit(""))


@function("qs", "qsl", least=2, most=2)
def query_lower(c, x, key):
    return Val(_query(F.lower(to_str(x)), F.lower(to_str(key))), STR)


@function("qs2", least=2, most=2)
def query(c, x, key):
    return Val(_query(to_str(x), to_str(key)), STR)


@function("urldecode")
def url_decode(c, x):
    return Val(F.try_url_decode(filled(x)), STR)


def rewrite_query(url: str, keep) -> str | None:
    """``url`` with the parameters that ``keep(name)`` accepts, in order of their names; None if its host cannot be one."""
    if not url:
        return None
    full = url if "://" in url else f"http://{url}"
    try:
        u = urlsplit(full)
    except ValueError:
        return None
    if re.search(BAD_HOST, u.netloc):
        return None
    pairs = sorted(((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if keep(k)), key=lambda p: p[0])
    return u._replace(query=urlencode(pairs)).geturl()


@function("urlminusqs", least=2, most=2)
def url_minus(c, x, key):
    if not isinstance(key.literal, str):
        raise CompileProblem("the parameter must be a literal string")
    name = key.literal
    if not name:
        return Val(F.lit(None).cast("string"), STR)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda u: rewrite_query(u, lambda k: k != name))

    return Val(run(to_str(x)), STR)


@function("url.matchqs", least=1, most=None)
def url_match(c, x, *patterns):
    """A URL without its scheme, with the parameters whose names match a pattern; with none, without parameters."""
    try:
        rules = [re.compile(p.literal) for p in patterns]
    except (TypeError, re.error) as e:
        raise CompileProblem("patterns must be literal regular expressions") from e
    if not all(p.literal for p in patterns):
        raise CompileProblem("a pattern is empty")

    def short(u):
        got = rewrite_query(u, lambda k: any(r.search(k) for r in rules))
        return got and got.partition("://")[2]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(short)

    return Val(run(to_str(x)), STR)


def _agent_parts(s):
    """The features of a user agent as columns, by the conventions of browsers' strings."""
    ex = lambda p, k=1: F.nullif(F.regexp_extract(s, p, k), F.lit(""))
    has = lambda p: F.coalesce(s.rlike(p), F.lit(False))
    comment = F.regexp_extract(s, r"\(([^)]*)\)", 1)
    pieces = F.transform(F.split(comment, ";"), lambda p: F.trim(p))
    bot = has(r"(?i)bot\b|bot/|crawl|spider|slurp|facebookexternalhit|bingpreview")
    browser = F.when(has(r"Edge?/"), "Edge").when(has("OPR/|Opera"), "Opera").when(has("(?:Chrome|CriOS)/"), "Chrome").when(has("Firefox/"), "Firefox").when(has("MSIE |Trident/"), "Internet Explorer").when(has("Version/.*Safari/"), "Safari").otherwise(ex(r"([A-Za-z]+)/[\d.]+"))
    version = F.coalesce(ex(r"Edge?/([\d.]+)"), ex(r"(?:OPR|Opera)[/ ]([\d.]+)"), ex(r"(?:Chrome|CriOS)/([\d.]+)"), ex(r"Firefox/([\d.]+)"), ex(r"MSIE ([\d.]+)"), ex(r"Version/([\d.]+)"), ex(r"[A-Za-z]+/([\d.]+)"))
    os = F.coalesce(ex(r"(Windows NT [\d.]+|Android [\d.]+|Intel Mac OS X [\d_.]+|CPU (?:iPhone )?OS [\d_]+|Linux [\w]+|CrOS [\w ]+)"), ex(r"(Linux|Android|Windows)"))
    engine = F.when(has("AppleWebKit/"), "AppleWebKit").when(has("Gecko/"), "Gecko").when(has("Trident/"), "Trident").when(has("Presto/"), "Presto")
    return {
        "bot": bot.cast("string"), "mobile": has(r"Mobile|iPhone|iPod|Android.*Mobile|Windows Phone").cast("string"), "mozilla": ex(r"^Mozilla/([\d.]+)"), "platform": F.nullif(F.get(pieces, F.lit(0)), F.lit("")), "os": os,
        "engine": engine, "engine_version": F.coalesce(ex(r"AppleWebKit/([\d.]+)"), ex(r"Gecko/([\d.]+)"), ex(r"Trident/([\d.]+)"), ex(r"Presto/([\d.]+)")), "browser": browser, "browser_version": version,
    }


@function("useragent", least=2, most=2)
def user_agent(c, x, feature):
    parts = _agent_parts(filled(x))
    if feature.literal not in parts:
        raise CompileProblem(f"no feature {feature.literal!r} of user agents")
    return Val(F.when(filled(x).isNotNull(), parts[feature.literal]), STR)


@function("useragent.map")
def user_agent_map(c, x):
    parts = _agent_parts(filled(x))
    made = F.map_from_arrays(F.array(*[F.lit(k) for k in parts]), F.array(*[F.coalesce(v, F.lit("")) for v in parts.values()]))
    return Val(F.when(filled(x).isNotNull(), made), MAP)
