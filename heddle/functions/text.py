"""Text columns: normalizers, title repairs, tokens, identity keys, timestamps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_WIDTH = "​‌‍⁠﻿"
SEPARATOR = "\u001f"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Trim Unicode white space and turn each run of it into one space."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)\s+", " "), r"^ | $", "")


def strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def optional(c: Column | str) -> Column:
    """Stripped text; blank is null."""
    return F.nullif(strip(c), F.lit(""))


def normalize(c: Column | str) -> Column:
    """The catalog's normalizer: only the small letter yo is folded (a capital one is
    lower-cased after that and stays), URLs go, letters, digits, ``+`` and ``#`` stay, and all
    else is one space."""
    low = F.lower(F.replace(col(c), F.lit("ё"), F.lit("е")))
    bare = F.regexp_replace(low, r"(?:https?:|magnet:)\S+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}+#]+", " "), r" +", " "))


def search_text(c: Column | str) -> Column:
    """The search side's normalizer: lower-cased first (so both letters yo are folded),
    zero-width characters dropped, white space squeezed.  NFC comes before, see ``nfc``."""
    low = F.replace(F.lower(col(c)), F.lit("ё"), F.lit("е"))
    return squeeze(F.translate(low, ZERO_WIDTH, ""))


def _composed(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column | str) -> Column:
    """Unicode composition; rows without combining marks stay in the JVM."""
    c = col(c)
    return F.when(c.rlike(r"\p{M}"), F.pandas_udf(_composed, "string")(c)).otherwise(c)


def clean_title(c: Column | str) -> Column:
    """Drop apostrophes right before a leading bracket, and repeated bullets or dashes that a
    blank follows."""
    t = strip(c)
    t = F.when(t.rlike(r"^['’]+\["), F.regexp_replace(t, r"^['’]+", "")).otherwise(t)
    return strip(F.regexp_replace(t, r"(?U)^(?:[-—–•] \s*)+", ""))


def identity_title(title: Column | str, year: Column | str) -> Column:
    """A title without a dangling ``(YYYY`` that repeats its year."""
    t = col(title)
    dangling = F.regexp_extract(t, r"\s+\((\d{4})\z", 1)
    return F.when((dangling != "") & (dangling == col(year).cast("string")), strip(F.regexp_replace(t, r"\s+\(\d{4}\z", ""))).otherwise(t)


def malformed_author(title: Column | str) -> Column:
    """``Author] Title`` and ``[Author| Title`` (also ``[Author|] Title``) as struct(author,
    title); null if neither, or if one of them is blank."""
    t = col(title)
    a, b = r"(?s)^([^\[\]]*)\](.*)$", r"(?s)^\[([^|]*)\|\]?(.*)$"
    part = lambda p: F.struct(strip(F.regexp_extract(t, p, 1)).alias("author"), strip(F.regexp_extract(t, p, 2)).alias("title"))
    found = F.when(t.startswith("["), part(b)).otherwise(part(a))
    return F.when((found["author"] != "") & (found["title"] != ""), found)


SHORT_DATE = r"^\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?\z"
RANGE_DASH = "―"


def date_range_heading(title: Column | str, author: Column | str, raw: Column | str, year: Column | str) -> Column:
    """Repair of a heading ``[Provider] Event 01.02 ― 03.04`` that was read as author ``Event
    01.02`` and title ``03.04``: struct(author, title) with the provider as author and both
    halves as title; null where the first line of the raw block does not say just that."""
    t, who = squeeze(title), squeeze(author)
    line = squeeze(F.element_at(F.split(col(raw), "\n", 2), 1))
    line = F.when(line.startswith("[["), F.substring(line, 2, 1 << 30)).otherwise(line)
    labels = F.filter(F.transform(F.regexp_extract_all(F.regexp_extract(line, r"^((?:\[[^\]]+\]\s*)+)", 1), F.lit(r"\[([^\]]+)\]"), F.lit(1)), squeeze), lambda x: x != "")
    rest = F.regexp_replace(line, r"^(?:\[[^\]]+\]\s*)+", "")
    body = squeeze(F.regexp_replace(rest, r"^\]", ""))
    tail = F.concat(F.lit(" ("), col(year).cast("string"), F.lit(")"))
    body = F.when(col(year).isNotNull() & body.endswith(tail), squeeze(F.substring(body, F.lit(1), F.char_length(body) - F.char_length(tail)))).otherwise(body)
    at = F.instr(body, RANGE_DASH)
    left, right = squeeze(F.substring(body, F.lit(1), at - 1)), squeeze(F.substring(body, at + 1, F.lit(1 << 30)))
    said = t.rlike(SHORT_DATE) & F.element_at(F.split(who, " "), -1).rlike(SHORT_DATE)
    fits = said & ~rest.startswith("[") & (F.size(labels) > 0) & (at > 0) & (left == who) & (right == t)
    return F.when(fits, F.struct(F.try_element_at(labels, F.lit(1)).alias("author"), F.concat(left, F.lit(f" {RANGE_DASH} "), right).alias("title")))


URL_WORD = r"(?i)^https?://\S+$"


def url_words(title: Column | str) -> Column:
    """The words of a title that are HTTP addresses."""
    return F.filter(F.split(col(title), r"(?U)\s+"), lambda w: w.rlike(URL_WORD))


def without_words(title: Column | str, words: Column) -> Column:
    """A title without those of its words that are in ``words``, from the left, as long as
    something is left; the white space on both sides of a cut becomes one space."""
    t = col(title)
    pieces = F.regexp_extract_all(t, F.lit(r"(?U)(\s+|\S+)"), F.lit(1))
    gone = lambda p: F.array_contains(words, p)
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("cut"))

    def step(a: Column, p: Column) -> Column:
        blank = p.rlike(r"(?U)^\s")
        # white space next to a cut waits, as one space at most
        joined = F.when(a["cut"], F.when(blank, a["kept"]).when(a["kept"] == "", p).otherwise(F.concat(a["kept"], F.lit(" "), p))).otherwise(F.concat(a["kept"], p))
        return F.struct(F.when(gone(p), strip_right(a["kept"])).otherwise(joined).alias("kept"), (gone(p) | (a["cut"] & blank)).alias("cut"))

    cut = strip(F.aggregate(pieces, start, step, lambda a: a["kept"]))
    # a title of nothing but such words keeps its last one
    last = F.element_at(F.filter(pieces, lambda p: ~p.rlike(r"(?U)^\s")), -1)
    touched = F.arrays_overlap(pieces, words)
    return F.when(~F.coalesce(touched, F.lit(False)), t).when(cut == "", last).otherwise(cut)


def strip_right(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def tokens(c: Column | str) -> Column:
    """Words of a normalized text; none of an empty one."""
    return F.filter(F.split(col(c), " "), lambda w: w != "")


def has_any(words: Column, values: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(v) for v in values])) if values else F.lit(False)


def has_phrase(text: Column, phrase: Column | str) -> Column:
    """Whether a normalized text has the words of ``phrase`` one after another."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def token_affix(longer: Column, shorter: Column) -> Column:
    """Whether the words of ``shorter`` begin or end ``longer``, and are fewer."""
    return (shorter != "") & (longer.startswith(F.concat(shorter, F.lit(" "))) | longer.endswith(F.concat(F.lit(" "), shorter)))


def years_fit(a: Column, b: Column) -> Column:
    """An unknown year fits any."""
    return a.isNull() | b.isNull() | (a == b)


def identity_key(*parts: Column | str) -> Column:
    return F.concat_ws(SEPARATOR, *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def stable_id(key: Column | str, prefix: str = "course:") -> Column:
    """128 bits of the key's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(col(key), 256), 1, 32))


def instant(c: Column | str) -> Column:
    """The instant of a timestamp text; unreadable is the year 1."""
    return F.coalesce(F.try_to_timestamp(col(c)), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def distinct_text(arr: Column | str) -> Column:
    """Stripped, not blank, first-seen distinct."""
    return F.array_distinct(F.filter(F.transform(col(arr), strip), lambda x: x.isNotNull() & (x != "")))


def first_other_than(arr: Column | str, value: str) -> Column:
    return F.try_element_at(F.filter(col(arr), lambda x: x != value), F.lit(1))
