"""URL functions as SQL text: one form per page, hosts, publishers, and addresses that mustn't be fetched."""

from __future__ import annotations

from groundwork.functions import literals as L
from groundwork.functions.literals import spark_text as q

# Suffixes of more than one label below which names are registered.
SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp com.br com.mx co.in co.za com.cn com.tr co.kr github.io"
BLOCKED_HOSTS = "localhost metadata.google.internal"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\\\[[^\\\\]]*\\\\]|[^/?#:]*)', 1))"


def domain(url: str) -> str:
    return f"regexp_replace({host(url)}, '^www\\\\.', '')"


def canonical(url: str) -> str:
    """Without tracking parameters and fragment; null unless http or https. The host is lower case, and a bare host has a path."""
    plain = f"regexp_replace({url}, '#.*$', '')"
    base, query = f"regexp_extract({plain}, '^([^?]*)', 1)", f"regexp_extract({plain}, '\\\\?(.*)$', 1)"
    kept = f"filter(split({query}, '&'), p -> p != '' and not p rlike {q('(?i)' + L.TRACKING)})"
    rest = f"regexp_replace({base}, '^[A-Za-z]+://[^/]*', '')"
    scheme = f"lower(regexp_extract({base}, '^([A-Za-z]+://)', 1))"
    where = f"lower(regexp_extract({base}, '^[A-Za-z]+://([^/]*)', 1))"
    asked = f"case when size({kept}) = 0 then '' else concat('?', array_join({kept}, '&')) end"
    return f"case when {url} rlike '(?i)^https?://[^/?#]+' then concat({scheme}, {where}, case when {rest} = '' then '/' else {rest} end, {asked}) end"


def read_suffixes(path: str) -> str:
    """The suffixes of two labels in a file of public suffixes: one a line, // begins a comment. Rules with * or ! are left out."""
    with open(path, encoding="utf-8") as f:
        lines = (line.split("//")[0].strip().lower() for line in f)
        return " ".join(sorted({line for line in lines if line.count(".") == 1 and not set(line) & set("*!")}))


def publisher(url: str, suffixes: str = SUFFIXES) -> str:
    """The registrable domain: the longest known suffix and one label more. suffixes: those of two labels, as read_suffixes
    gives them; without a file, a short list."""
    labels = f"split({domain(url)}, '\\\\.')"
    two = f"array_join(slice({labels}, -2, 2), '.')"
    three = f"array_join(slice({labels}, -3, 3), '.')"
    known = L.spark_words(suffixes)
    return f"case when size({labels}) < 2 then {domain(url)} when size({labels}) > 2 and array_contains({known}, {two}) then {three} else {two} end"


def last_two_labels(url: str) -> str:
    labels = f"split({host(url)}, '\\\\.')"
    return f"case when size({labels}) < 2 then {host(url)} else array_join(slice({labels}, -2, 2), '.') end"


def forbidden(url: str) -> str:
    """Schemes other than http, hosts of the own network, and private addresses."""
    h = f"regexp_replace({host(url)}, '[\\\\[\\\\]]', '')"
    octets = f"transform(split({h}, '\\\\.'), x -> try_cast(x as int))"
    v4 = f"{h} rlike '^[0-9]{{1,3}}(\\\\.[0-9]{{1,3}}){{3}}$'"
    a, b = f"{octets}[0]", f"{octets}[1]"
    private = f"({a} in (0, 10, 127) or ({a} = 100 and {b} between 64 and 127) or ({a} = 169 and {b} = 254) or ({a} = 172 and {b} between 16 and 31) or ({a} = 192 and {b} = 168))"
    v6 = f"{h} rlike '^(::1$|f[cd][0-9a-f]{{2}}:|fe[89ab][0-9a-f]:)'"
    named = f"array_contains({L.spark_words(BLOCKED_HOSTS)}, {h}) or {h} like '%.localhost' or {h} like '%.local' or {h} like '%.internal'"
    return f"(not coalesce({url} rlike '(?i)^https?://', false) or {named} or ({v4} and {private}) or {v6})"


def path(url: str) -> str:
    return f"coalesce(nullif(regexp_replace({url}, '^[A-Za-z]+://[^/]*|[?#].*$', ''), ''), '/')"
