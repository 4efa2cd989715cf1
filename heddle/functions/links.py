"""Link columns: canonical form or reason of rejection, hash, host and its suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import addresses
from heddle.functions.contents import bound
from heddle.functions.text import col, strip

# Reasons of rejection.
REASONS = ("empty", "control_character", "invalid_url", "unsupported_scheme", "missing_host", "credentials", "invalid_port", "local_target", "invalid_magnet")

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_SAFE_PATH = r"^[A-Za-z0-9\-._~!$&'()*+,;=:@/%]*\z"


# Unspecified, private, loopback, link-local and multicast blocks.
LOCAL_BLOCKS = ("0.0.0.0/32", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "::/127", "fc00::/7", "fe80::/10", "ff00::/8")


def is_local(host: Column | str) -> Column:
    """localhost and its subdomains, and local, private and multicast addresses."""

    def judged(h: Column) -> Column:
        # names of hosts are not parsed
        address = F.when(h.contains(":") | h.rlike(r"^[0-9.]+$"), addresses.parse(h))
        return F.when((h == "localhost") | h.endswith(".localhost"), True).otherwise(F.coalesce(bound(address, lambda a: addresses.is_in(a, LOCAL_BLOCKS)), F.lit(False)))

    return bound(F.regexp_replace(F.lower(col(host)), r"\.$", ""), judged)


def _escaped(path: Column) -> Column:
    """Escape what may not stand in a path as it is; null for broken escapes."""
    one = lambda c: F.when(c.rlike(_SAFE_PATH), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))
    return F.when(~path.rlike("%(?![0-9A-Fa-f]{2})"), F.array_join(F.transform(F.regexp_extract_all(path, F.lit("(?s)(.)"), F.lit(1)), one), ""))


def magnet_ok(raw: Column) -> Column:
    """Whether a magnet link names content by a BitTorrent hash (40 hex or 32 base32)."""
    query = F.split(F.regexp_extract(raw, r"^[^?]*\?([^#]*)", 1), "&")
    values = F.transform(F.filter(query, lambda q: F.lower(q).startswith("xt=")), lambda q: F.coalesce(F.try_url_decode(F.substring(q, 4, 10000)), F.lit("")))
    return F.exists(values, lambda v: v.rlike(r"(?i)^urn:btih:([0-9a-f]{40}|[a-z2-7]{32})$"))


def parts(raw: Column | str) -> Column:
    """A link cut in pieces: t (trimmed), scheme, user (whether there is one), hostport, host,
    tail (after the host), path, query."""
    t = strip(raw)
    authority = F.regexp_extract(t, _AUTHORITY, 1)
    hostport = F.regexp_replace(authority, r"^.*@", "")
    v6 = hostport.startswith("[")
    rest = F.regexp_replace(F.regexp_replace(t, r"(?s)^[^/?#]*//[^/?#]*", ""), r"(?s)#.*$", "")
    return F.struct(
        t.alias("t"),
        F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"),
        authority.contains("@").alias("user"),
        hostport.alias("hostport"),
        F.lower(F.when(v6, F.regexp_extract(hostport, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(hostport, r"^([^:]*)", 1))).alias("host"),
        F.when(v6, F.regexp_extract(hostport, r"^\[[^\]]*\](.*)$", 1)).otherwise(F.regexp_extract(hostport, r"^[^:]*(.*)$", 1)).alias("tail"),
        F.regexp_extract(rest, r"(?s)^([^?]*)", 1).alias("path"),
        F.regexp_extract(rest, r"(?s)(\?.*)$", 1).alias("query"),
    )


def judge(p: Column) -> Column:
    """struct(scheme, host, canonical, rejection) of a link's parts.

    Canonical: scheme and host in lower case, no default port, no fragment; path case and
    query order as they are.  ``rejection`` is null for a link that is kept."""
    t, scheme, hostport, host, tail, path = (p[c] for c in ("t", "scheme", "hostport", "host", "tail", "path"))
    digits = F.regexp_replace(F.regexp_extract(tail, r"^:(\d+)$", 1), r"^0+", "")
    port = F.when(digits.rlike(r"^\d{1,5}$"), digits.cast("int"))
    bad_port = (tail != "") & (~tail.rlike(r"^:\d+$") | port.isNull() | (port < 1) | (port > 65535))
    shown = F.when(path.rlike(_SAFE_PATH), path).otherwise(_escaped(path))
    broken = F.regexp_replace(path, r"%[0-9A-Fa-f]{2}", "").contains("%") | hostport.rlike(r"[\s<>\"{}|\\^`]") | host.contains("%")
    name = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    default = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    named = F.when(port.isNotNull() & ~default, F.concat(name, F.lit(":"), port.cast("string"))).otherwise(name)
    http = scheme.isin("http", "https")
    rejection = (
        F.when(t.isNull() | (t == ""), "empty")
        .when(t.rlike(r"\p{Cc}"), "control_character")
        .when(http & bad_port, "invalid_port")
        .when((scheme == "") | http & broken, "invalid_url")
        .when(scheme == "magnet", F.when(~magnet_ok(t), "invalid_magnet"))
        .when(~http, "unsupported_scheme")
        .when(host == "", "missing_host")
        .when(p["user"], "credentials")
        .when(is_local(host), "local_target")
    )
    canonical = F.when(scheme == "magnet", t).otherwise(F.concat(scheme, F.lit("://"), named, shown, p["query"]))
    return F.struct(scheme.alias("scheme"), host.alias("host"), canonical.alias("whole"), rejection.alias("rejection"))


def with_link(df: DataFrame, raw: Column | str, name: str = "link") -> DataFrame:
    """``df`` with ``name``: struct(scheme, host, canonical, rejection) of a link.

    In three steps, so that pieces that are used often are computed once."""
    out = df.withColumn("_parts", parts(raw)).withColumn("_judged", judge(F.col("_parts")))
    j = F.col("_judged")
    canonical = F.when(j["rejection"].isNull(), j["whole"])
    link = F.struct(j["scheme"].alias("scheme"), j["host"].alias("host"), canonical.alias("canonical"), j["rejection"].alias("rejection"))
    return out.withColumn(name, link).drop("_parts", "_judged")


def link_hash(canonical: Column | str) -> Column:
    return F.sha2(col(canonical), 256)


def host_suffixes(host: Column | str) -> Column:
    """A host and all its parent domains, so that suffix rules become equal keys."""
    labels = F.split(col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, 10000), "."))


def actionable(title: Column, raw: Column, author: Column, link: Column, labels: Column) -> Column:
    """Whether a link is more than a bare domain that a title or credit mentions.

    ``link`` is the struct (url, host, provider, kind, role, primary, label, normalized_from,
    sources), ``labels`` are those of all links of the entry."""
    bare = lambda u: F.regexp_replace(strip(u), r"[.,;:)>\]}'\"]+$", "")
    same = lambda u: F.struct(
        F.lower(F.regexp_extract(bare(u), r"(?i)^https?://([^/?#]*)", 1)), F.regexp_replace(F.regexp_extract(bare(u), r"(?i)^https?://[^/?#]*([^?#]*)", 1), r"/+$", ""), F.regexp_extract(bare(u), r"\?([^#]*)", 1)
    )
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    always = F.coalesce(link["primary"], F.lit(False)) | (low(link["role"]) == "primary") | (low(link["kind"]) == "file_host") | (low(link["provider"]) == "magnet") | low(strip(link["url"])).startswith("magnet:")
    said = F.concat_ws("\n", title, raw, author, F.array_join(F.coalesce(labels, F.array().cast("array<string>")), "\n"))
    explicit = link["url"].rlike(r"(?i)^\s*https?://") & F.exists(F.regexp_extract_all(said, F.lit(r"(?i)(https?://\S+)"), F.lit(1)), lambda u: same(u) == same(link["url"]))
    origin = F.transform(F.coalesce(link["sources"], F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))
    alone = F.exists(origin, lambda s: s.contains("standalone") & (s.contains("link") | s.contains("url") | s.contains("domain")))
    credited = F.exists(origin, lambda s: s.contains("title") | s.contains("credit") | s.contains("author"))
    label = low(strip(link["label"]))
    labelled = (label != "") & ((label == low(strip(title))) | (label == low(strip(author))))
    host = F.regexp_replace(F.coalesce(F.nullif(low(F.trim(link["host"])), F.lit("")), low(F.regexp_extract(link["url"], r"(?i)^\s*https?://([^/?#]*)", 1))), r"^www\.", "")
    mentioned = (host != "") & (low(title).contains(host) | low(author).contains(host))
    domain = F.coalesce(strip(link["normalized_from"]), F.lit("")).rlike(r"(?iu)^(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}$")
    return always | explicit | alone | ~(domain & (credited | labelled | mentioned))
