"""Column to Column functions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector or different lengths."""
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def is_zero(v: Column) -> Column:
    """Every component below 1e-10 in size; so is an empty vector."""
    return F.forall(v, lambda x: F.abs(x) < 1e-10)


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")).cast("float"))


def quantise(v: Column) -> Column:
    """Signed bytes, the largest component scaled to 127 and positive ones capped at 126; truncated towards zero."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.lit(127.0) / F.when(top > 0, top).otherwise(1.0)
    return F.transform(v, lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(126.0)), F.lit(-127.0)).cast("tinyint"))


def quantise_plain(v: Column) -> Column:
    """Components times 127, truncated; neither scaled nor capped."""
    return F.transform(v, lambda x: (x.cast("double") * 127).cast("int"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def shard_id(key: Column, shards: int = 256) -> Column:
    """First four bytes of the key's SHA-256, big-endian, modulo ``shards``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % shards).cast("int")


def shard_path(key: Column, shards: int = 256, base: str = "") -> Column:
    """Path of the key's shard; null for a key that isn't a plain name."""
    safe = key.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9_.-]*$") & ~key.contains("..")
    return F.when(safe, F.concat(F.lit(base), F.format_string("shard_%03d/%s.parquet", shard_id(key, shards), key)))


def summary(text: Column, sentences: int = 3) -> Column:
    """The first sentences: split at full stops, trimmed, empty ones left out, joined without a stop at the end."""
    trimmed = F.transform(F.split(text, r"\."), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.array_join(F.slice(F.filter(trimmed, lambda s: s != ""), 1, sentences), ". ")


def checksums_compatible(a: Column, b: Column) -> Column:
    """Both have the 64 digits of a SHA-256."""
    return F.coalesce((F.length(a) == 64) & (F.length(b) == 64), F.lit(False))


def key_part(text: Column) -> Column:
    """Letters, digits and underscores, 50 at most, ``unknown`` if nothing is there."""
    clean = F.substring(F.regexp_replace(text, "[^a-zA-Z0-9_]", "_"), 1, 50)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def last_part(name: Column) -> Column:
    """What follows the last full stop of a dotted name."""
    return F.element_at(F.split(name, r"\."), -1)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def merged(first: Column, *later: Column) -> Column:
    """Maps joined, later keys winning over earlier ones, whatever the session's duplicate-key policy."""
    none = F.create_map().cast("map<string,string>")
    out = F.coalesce(first, none)
    for m in later:
        out = _over(out, F.coalesce(m, none))
    return out


def _over(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def upload_ids(path: Column) -> Column:
    """(system_id, upload_id) of a path that holds ``systems/<system>/<upload>/``."""
    pattern = r"systems/([^/]+)/([^/]+)/"
    part = lambda k: F.nullif(F.regexp_extract(path, pattern, k), F.lit(""))
    return F.struct(part(1).alias("system_id"), part(2).alias("upload_id"))


def nearest_rank(values: Column, q: float = 0.99) -> Column:
    """Element int(n * q) of the sorted values, counted from 0, the last at most."""
    n = F.size(values)
    return F.element_at(F.array_sort(values), (F.least((n * F.lit(q)).cast("int"), n - 1) + 1).cast("int"))


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct runs of ``width`` words; a shorter text is one run."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    # shifted copies side by side: a lambda that looked into the words would split the text anew for each run
    many = F.size(words) - (width - 1)
    shifted = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(many, F.lit(0))).alias(f"w{k}") for k in range(width)])
    runs = F.transform(shifted, lambda z: F.concat_ws(" ", *[z[f"w{k}"] for k in range(width)]))
    return F.when(many > 0, F.array_distinct(runs)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
