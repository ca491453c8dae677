"""URLs and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskscan.functions.secrets import mask, name_looks_secret


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    """The host, also of addresses that programs accept although they hold signs the syntax forbids."""
    readable = F.regexp_replace(F.translate(F.substring_index(url, "#", 1), "\\", "/"), r"[\s\"<>^`{|}]", "_")
    return F.lower(part(readable, "HOST"))


def password(url: Column) -> Column:
    """The password in the address, if any: all that follows the first colon of the user part."""
    info = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)@", 1)
    return F.when(info.contains(":"), F.regexp_replace(info, "^[^:]*:", ""))


def query_pairs(url: Column) -> Column:
    """Query parameters with a value, in order, as an array of (name, value)."""
    pairs = F.filter(
        F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda p: p.rlike("^[^=]+=.")
    )
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("name"), F.regexp_replace(p, "^[^=]*=", "").alias("value")
        ),
    )


def _masked_pairs(pairs: Column) -> Column:
    """`name=value` pairs joined by `&`, values of secret-looking names hidden, all else as it is."""

    def shown(p: Column) -> Column:
        name, value = F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=", "")
        secret = p.rlike("(?s)^[^=]+=.") & name_looks_secret(F.substring_index(name, "?", -1))
        return F.when(secret, F.concat(name, F.lit("="), mask(value))).otherwise(p)

    return F.array_join(F.transform(F.split(pairs, "&"), shown), "&")


def masked(url: Column) -> Column:
    """The URL with its password and the secret-looking values of its query and fragment hidden."""
    secret = F.coalesce(password(url), F.lit(""))
    shown = F.when(
        secret != "", F.replace(url, F.concat(F.lit(":"), secret, F.lit("@")), F.lit(":****@"))
    ).otherwise(url)
    base = F.regexp_extract(shown, "(?s)^[^?#]*", 0)
    query = F.regexp_extract(shown, r"(?s)^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(shown, "(?s)^[^#]*#(.*)", 1)
    return F.when(
        shown.rlike("[?#]"),
        F.concat(
            base,
            F.when(F.substring_index(shown, "#", 1).contains("?"), F.concat(F.lit("?"), _masked_pairs(query))).otherwise(""),
            F.when(shown.contains("#"), F.concat(F.lit("#"), _masked_pairs(fragment))).otherwise(""),
        ),
    ).otherwise(shown)


def _v4(address: Column) -> Column:
    octets = F.transform(F.split(address, r"\."), lambda o: o.cast("long"))
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
    return F.when(address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), value)


def _in_net(value: Column, base: int, bits: int) -> Column:
    return value.between(base, base + (1 << (32 - bits)) - 1)


# IPv4 blocks by purpose.
LOOPBACK = ((0x7F000000, 8),)
LINK_LOCAL = ((0xA9FE0000, 16),)
PRIVATE = ((0x0A000000, 8), (0xAC100000, 12), (0xC0A80000, 16), (0x00000000, 8))


def _any_net(value: Column, blocks: tuple[tuple[int, int], ...]) -> Column:
    found = F.lit(False)
    for base, bits in blocks:
        found = found | _in_net(value, base, bits)
    return F.coalesce(found, F.lit(False))


def is_local_host(name: Column) -> Column:
    """Loopback, private and link-local addresses, and the usual local names."""
    bare = F.btrim(F.lower(name), F.lit("[]"))
    named = bare.isin("localhost", "host.docker.internal") | bare.endswith(".localhost")
    v6 = bare.rlike(r"^::1$|^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:")
    return F.coalesce(named | v6 | _any_net(_v4(bare), LOOPBACK + LINK_LOCAL + PRIVATE), F.lit(False))


def is_own_machine(name: Column) -> Column:
    """Loopback, unspecified and link-local only: a private address is still outside this machine."""
    bare = F.btrim(F.lower(name), F.lit("[]"))
    v4 = _v4(bare)
    return F.coalesce(
        (bare == "localhost")
        | bare.rlike(r"^::1?$|^fe[89ab][0-9a-f]:")
        | (v4 == 0)
        | _any_net(v4, LOOPBACK + LINK_LOCAL),
        F.lit(False),
    )


def repository_key(url: Column) -> Column:
    """`host/owner/repo` of a repository URL, or null."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    parts = F.filter(F.split(F.coalesce(part(full, "PATH"), F.lit("")), "/"), lambda p: p != "")
    name = F.regexp_replace(F.lower(F.get(parts, F.lit(1))), r"\.git$", "")
    return F.when(
        (F.size(parts) >= 2) & part(full, "HOST").isNotNull(),
        F.concat_ws("/", F.regexp_replace(host(full), r"^www\.", ""), F.lower(F.get(parts, F.lit(0))), name),
    )


def kebab(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
