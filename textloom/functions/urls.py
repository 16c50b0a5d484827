"""URL parsing and the feature names mined from URLs, as Column builders.

The strict parse_url refuses decoded URLs (spaces, bars), so parts are taken by pattern after decoding. Lengths are in bytes of UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(url: Column) -> Column:
    """Percent-decoded; a plus stays a plus and a percent sign without two hexadecimal digits stays as it is."""
    safe = F.replace(F.regexp_replace(url, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(safe), url)


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)


def segments(url: Column) -> Column:
    """array<string> of the path's segments that aren't empty."""
    return F.filter(F.split(path(url), "/", -1), lambda s: s != "")


def params(url: Column) -> Column:
    """array<struct<name, values>> in order of the names' first use; a blank value is dropped, repeated names gather their values."""
    parts = F.filter(F.split(query(url), "[&;]", -1), lambda s: s.rlike("^[^=]*=.+"))
    spaced = lambda s: decoded(F.replace(s, F.lit("+"), F.lit(" ")))
    pairs = F.transform(parts, lambda s: F.struct(spaced(F.substring_index(s, "=", 1)).alias("name"), spaced(F.regexp_extract(s, "^[^=]*=(.*)$", 1)).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"]).alias("values")))


def _quoted(values: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(values, "', '"), F.lit("']"))


def features(url: Column, lengths: bool = True) -> Column:
    """array<string> of the features of one URL, each once.

    segments:N, param_name:K, param:K=['v'], and for each segment I: segment_name_I:S, segment_len_I:BYTES (with lengths),
    segment_[0-9]_I:1 all digits, segment_substr[0-9]_I:1 digits inside, segment_ext_I:EXT, segment_ext_substr[0-9]_I:EXT."""
    u = decoded(url)
    seg, par = segments(u), params(u)
    none = F.lit(None).cast("string")

    def of(s: Column, i: Column) -> Column:
        at = i.cast("string")
        ext = F.substring_index(s, ".", -1)
        return F.array(
            F.concat(F.lit("segment_name_"), at, F.lit(":"), s),
            F.concat(F.lit("segment_len_"), at, F.lit(":"), F.octet_length(s).cast("string")) if lengths else none,
            F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("segment_[0-9]_"), at, F.lit(":1"))),
            F.when(s.rlike("^[^0-9]+[0-9]+[^0-9]+$"), F.concat(F.lit("segment_substr[0-9]_"), at, F.lit(":1"))),
            F.when(s.rlike("^.+\\..+$"), F.concat(F.lit("segment_ext_"), at, F.lit(":"), ext)),
            F.when(s.rlike("^[^0-9]+[0-9]+[^0-9]+\\..+$"), F.concat(F.lit("segment_ext_substr[0-9]_"), at, F.lit(":"), ext)),
        )

    named = F.transform(par, lambda p: F.concat(F.lit("param_name:"), p["name"]))
    valued = F.transform(par, lambda p: F.concat(F.lit("param:"), p["name"], F.lit("="), _quoted(p["values"])))
    count = F.array(F.concat(F.lit("segments:"), F.size(seg).cast("string")))
    every = F.concat(count, named, valued, F.flatten(F.transform(seg, of)))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))
