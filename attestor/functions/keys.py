"""Keys, references, numbers and media fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.text import collapse_spaces, normalize


def text_key(text: Column) -> Column:
    """First 20 hex digits of SHA-1."""
    return F.substring(F.sha1(text), 1, 20)


def input_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def search_key(text: Column, compat: bool = True) -> Column:
    return F.concat(F.lit("search:"), normalize(F.substring(collapse_spaces(text), 1, 200), compat=compat))


def id_key(endpoint: str, record_id: Column) -> Column:
    """Keys of the alternate (``alts``) and similar (``sims``) end points."""
    return F.concat(F.lit(f"{endpoint}:"), record_id)


def record_number(first: Column, second: Column) -> Column:
    """The first number unless missing or 0, else the second, without a fraction of zero."""
    n = F.coalesce(F.nullif(first, F.lit(0)), second)
    return F.when(n == F.floor(n), F.floor(n).cast("long").cast("string")).otherwise(n.cast("string"))


def record_url(base: str, slug: Column, number: Column) -> Column:
    """base/slug:number up to the first . or -."""
    return F.concat(F.lit(base), slug, F.lit(":"), F.substring_index(F.substring_index(number, ".", 1), "-", 1))


def narrator(text_en: Column) -> Column:
    """Who narrates, from the start of an English text: up to 80 characters before the colon."""
    found = F.trim(F.regexp_extract(text_en, r"(?i)^\s*(?:narrated|it was narrated from|it was narrated that)\s+([^:]{2,80}?)\s*:", 1))
    return F.when(found != "", found)


def passage_ref(chapter: Column, first: Column, chapter_end: Column, last: Column) -> Column:
    """c:v, c:v-w, or c:v-d:w where a range crosses chapters."""
    head = F.concat_ws(":", chapter, first)
    return (
        F.when(chapter != chapter_end, F.concat(head, F.lit("-"), F.concat_ws(":", chapter_end, last)))
        .when(first != last, F.concat(head, F.lit("-"), last.cast("string")))
        .otherwise(head)
    )


def parse_ref(ref: Column) -> Column:
    """Struct (chapter, first, chapter_end, last) of all three forms of passage_ref."""
    part = lambda i: F.nullif(F.regexp_extract(ref, r"^(\d+):(\d+)(?:-(?:(\d+):)?(\d+))?$", i), F.lit("")).cast("int")
    return F.struct(part(1).alias("chapter"), part(2).alias("first"), F.coalesce(part(3), part(1)).alias("chapter_end"), F.coalesce(part(4), part(2)).alias("last"))


def client_key(forwarded: Column, peer: Column) -> Column:
    """First hop of a forwarded-for header, else the peer, else ``unknown``."""
    hop = F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(hop, F.lit("")), F.nullif(peer, F.lit("")), F.lit("unknown"))


def image_bytes(b64: Column) -> Column:
    """Bytes of base64 with or without a data-URL prefix; null if it is neither."""
    return F.try_to_binary(F.regexp_replace(b64, r"^data:[^,]*,", ""), F.lit("base64"))


def media_type(raw: Column) -> Column:
    """By magic bytes: PNG, JPEG, WebP, GIF, else null."""
    h = F.hex(F.substring(raw, 1, 12))
    return (
        F.when(h.startswith("89504E47"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("47494638"), "image/gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
    )
