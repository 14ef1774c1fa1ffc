"""Native classifiers of hosts, cookies, headers and tokens, and the gate of context words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkveil.kernel.recognize import STANDARDS, WINDOW
from larkveil.kernel.structured import COOKIE_SECRETS, INTERNAL_ENDINGS, QUERY_SECRETS, SIGNATURES


def listed(host: Column, names: list[str] | tuple[str, ...]) -> Column:
    """Whether a host is one of some names or lies under one."""
    own = [n for x in names if (n := x.strip().lower().lstrip("."))]
    out = F.lit(False)
    for n in own:
        out = out | (host == n) | F.endswith(host, F.lit("." + n))
    return out


def _internal_ending(host: Column) -> Column:
    return host.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in INTERNAL_ENDINGS) + ")$")


def host_class(host: Column, usual: Column, customer=(), internal=()) -> Column:
    h = F.lower(host)
    return F.when(listed(h, customer), "CUSTOMER_DOMAIN").when(listed(h, internal) | _internal_ending(h), "INTERNAL_DOMAIN").otherwise(usual)


def is_internal(host: Column, internal=()) -> Column:
    h = F.lower(host)
    return listed(h, internal) | ~F.contains(h, F.lit(".")) | _internal_ending(h)


def cookie_class(name: Column) -> Column:
    n = F.lower(F.trim(name))
    out = F.lit(None).cast("string")
    for cls in sorted(set(COOKIE_SECRETS.values())):
        out = F.when(n.isin([k for k, c in COOKIE_SECRETS.items() if c == cls]), cls).otherwise(out)
    return out


def query_secret(key: Column) -> Column:
    n = F.lower(key)
    return F.when(n.isin([k for k, c in QUERY_SECRETS.items() if c == "ACCESS_TOKEN"]), "ACCESS_TOKEN").when(n.isin([k for k, c in QUERY_SECRETS.items() if c == "API_KEY"]), "API_KEY")


def url_class(url: Column, internal=()) -> Column:
    """URL, INTERNAL_URL, SIGNED_URL or SAS_TOKEN."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    keys = F.transform(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))))
    signed = F.arrays_overlap(keys, F.array(*[F.lit(x) for x in sorted(SIGNATURES)]))
    return F.when(signed & F.array_contains(keys, "sv"), "SAS_TOKEN").when(signed, "SIGNED_URL").when(is_internal(host, internal), "INTERNAL_URL").otherwise("URL")


def is_web_token(value: Column) -> Column:
    """Whether the first of three parts is the header of a JSON web token."""
    head = F.translate(F.split_part(value, F.lit("."), F.lit(1)), "-_", "+/")
    padded = F.rpad(head, (F.ceil(F.length(head) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.coalesce(value.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$") & F.get_json_object(decoded, "$.alg").isNotNull(), F.lit(False))


def has_word(text: Column, start: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether one of some words stands, bounded, in the characters before a place."""
    before = F.substr(text, F.greatest(F.lit(1), start - WINDOW + 1), F.least(F.lit(WINDOW), start))
    quoted = "|".join(r"\Q" + w + r"\E" for w in words)
    return before.rlike(f"(?iu)(?<![A-Za-z0-9])(?:{quoted})(?![A-Za-z0-9])")


def is_standard(value: Column) -> Column:
    """ISO-9001 and its like, which are no ids."""
    return F.upper(F.split_part(value, F.lit("-"), F.lit(1))).isin(STANDARDS)
