"""Title normalization: entity and underscore cleanup, and reverse transliteration of titles
that are Russian in Latin letters."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letter groups and the letters that they stand for.
LETTERS = {
    "shch": "щ", "sch": "щ", "yiy": "ый", "yih": "ых", "iya": "ия", "aya": "ая", "yo": "ё", "zh": "ж", "kh": "х", "ts": "ц", "ch": "ч", "sh": "ш", "yu": "ю", "ya": "я",
    "ey": "ей", "ay": "ай", "yi": "ы", "iy": "ий", "a": "а", "b": "б", "c": "с", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "дж", "k": "к", "l": "л",
    "m": "м", "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "ы", "z": "з", "'": "ь",
}
# Letter groups that speak for transliterated Russian, and how much.
MARKERS = {
    "onlayn": 4, "shch": 3, "dlya": 4, "nulya": 3, "yih": 3, "yiy": 3, "zh": 3, "kh": 3, "sch": 1, "aya": 1, "iya": 1, "ch": 1, "sh": 1, "ya": 1, "yu": 1, "yo": 1, "ay": 1,
}
# Short words that do, and letter groups that speak for English.
SHORT_WORDS = ("v", "s", "na", "do", "iz", "po", "za", "c")
ENGLISH = ("th", "tion", "ing", "ment")
LEAST_SCORE = 4


def _longest_first(keys) -> re.Pattern:
    return re.compile("|".join(re.escape(k) for k in sorted(keys, key=len, reverse=True)))


_GROUP, _MARKER = _longest_first(LETTERS), _longest_first(MARKERS)
_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_PIECE = re.compile(r"(?:[^\W_]|[_@:/]|(?<=[A-Za-z])'(?=[A-Za-z]))+|.", re.S)
_PART, _BRACKET = re.compile(r"\s+|\S+"), re.compile(r"[\[\]()]")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")


@dataclass(frozen=True)
class Rules:
    """Tokens that stay, titles that convert whatever their score, and which cleanups run."""

    protected_exact: frozenset = field(default_factory=frozenset)
    protected_ci: frozenset = field(default_factory=frozenset)
    protected_substrings: tuple = ()
    force_tokens: frozenset = field(default_factory=frozenset)
    force_phrases: tuple = ()
    decode_entities: bool = True
    drop_format_chars: bool = True
    strip_provider_noise: bool = True
    underscores: bool = True


def transliterate(word: str) -> str:
    out = _GROUP.sub(lambda m: LETTERS[m[0]], word.lower())
    return out[:1].upper() + out[1:] if "A" <= word[:1] <= "Z" else out


def _visible(text: str) -> bool:
    return any(not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc") for c in text)


def _network(text: str) -> bool:
    """An address, or what looks like a domain."""
    return "://" in text or "@" in text or "." in text and bool(_DOMAIN.fullmatch(text.strip("\"'()[]{}<>,;:!?")))


def _keeps_underscores(text: str, alone: bool) -> bool:
    if _network(text) or "/" in text or "\\" in text or _network(text.replace("_", "-")):
        return True
    return not alone and (any(c in "0123456789" for c in text) or any(re.fullmatch(r"(?=.*[A-Z])[A-Z0-9]{2,}", part) for part in text.split("_")))


# Quotes that may stand before a provider's label, and pairs around a whole title.
QUOTES = "'\"‘’“”„«»"
PAIRS = ("''", '""', "‘’", "“”", "„“", "„”", "«»")
_NOISE = re.compile(rf"([{QUOTES}]*)([0-9]+\.)?(?=\[[^\]]+\])")


def _without_noise(title: str) -> str:
    """A title without quotes and an ordinal before ``[provider]``, unless a pair of quotes
    holds the whole title."""
    paired = len(title) > 2 and title[0] + title[-1] in PAIRS
    return title if paired else title[_NOISE.match(title).end() if _NOISE.match(title) else 0 :]


def cleanup(title: str, rules: Rules) -> str:
    out = title
    if rules.decode_entities and "&" in out:
        out = _ENTITY.sub(lambda m: html.unescape(m[0]), out)
    if rules.drop_format_chars and not out.isascii():
        out = out.translate({ord(c): None for c in set(out) if unicodedata.category(c) == "Cf"})
    if rules.strip_provider_noise:
        out = _without_noise(out)
    if rules.underscores and "_" in out:
        alone = len(out.split()) <= 1
        out = "".join(x if x.isspace() or _keeps_underscores(x, alone) else re.sub("_+", " ", x) for x in re.split(r"(\s+)", out))
    return out if _visible(out) else title


@dataclass
class _Piece:
    text: str
    word: bool
    kept: bool = False  #: stays as it is
    yields: bool = False  #: but for a forced token


def _pieces(title: str, rules: Rules) -> list[_Piece]:
    out, square, round_, at = [], 0, 0, 0
    while at < len(title):
        if square or round_:
            # inside brackets all words stay, so those before the one with the next bracket are one piece
            bracket = _BRACKET.search(title, at)
            stop = bracket.start() if bracket else len(title)
            while bracket and stop > at and not title[stop - 1].isspace():
                stop -= 1
            if stop > at:
                out.append(_Piece(title[at:stop], True, True))
                at = stop
                continue
        part = _PART.match(title, at)[0]
        at += len(part)
        network = _network(part)
        for m in _PIECE.finditer(part):
            piece = _Piece(m[0], len(m[0]) > 1 or m[0].isalnum() or m[0] in "_@:/")
            square, round_ = square + (m[0] == "["), round_ + (m[0] == "(")
            if piece.word:
                own = network or square > 0 or round_ > 0 or _protected(m[0], rules)
                piece.kept = own or _looks_english(m[0])
                piece.yields = piece.kept and not own
            square, round_ = max(0, square - (m[0] == "]")), max(0, round_ - (m[0] == ")"))
            out.append(piece)
    return out


def _protected(word: str, rules: Rules) -> bool:
    low = word.lower()
    return word in rules.protected_exact or low in rules.protected_ci or any(s in low for s in rules.protected_substrings) or any(c in "0123456789_@/:" for c in word)


def _looks_english(word: str) -> bool:
    """A capitalized word with an English letter group, or capitals beyond the first letter (a
    leading SH counts as one)."""
    if "A" <= word[:1] <= "Z" and any(e in word.lower() for e in ENGLISH):
        return True
    rest = word[2:] if len(word) > 2 and word.startswith("SH") else word[1:]
    return any("A" <= c <= "Z" for c in rest) or bool(re.fullmatch(r"[^A-Za-z]*[A-Z][^A-Za-z]*", word))


def _latin(word: str) -> bool:
    return all(c == "'" or c.isascii() for c in word if c.isalpha() or c == "'") and any(c.isascii() and c.isalpha() for c in word)


def score(words: list[str]) -> int:
    total = 0
    for w in (x.lower() for x in words):
        total += sum(MARKERS[m] for m in _MARKER.findall(w)) + 2 * ("'" in w) + (w in SHORT_WORDS) - 3 * any(e in w for e in ENGLISH)
    return total


def _forced(pieces: list[_Piece], rules: Rules) -> bool:
    open_ = [p.text.lower() if p.word and (not p.kept or p.yields) else None if p.word else " " if p.text.isspace() else None for p in pieces]
    if any(t in rules.force_tokens for t in open_):
        return True
    said = re.sub(r"\s+", " ", "".join(t if t is not None else "\0" for t in open_))
    return any(re.search(rf"(?<![^\s\0]){re.escape(p)}(?![^\s\0])", said) for p in rules.force_phrases)


def normalize(title: str | None, rules: Rules = Rules()) -> str | None:  # noqa: B008
    """The cleaned title, transliterated if its open words look Russian enough."""
    if title is None:
        return None
    clean = cleanup(title, rules)
    pieces = _pieces(clean, rules)
    if score([p.text for p in pieces if p.word and not p.kept and _latin(p.text)]) < LEAST_SCORE and not _forced(pieces, rules):
        return clean

    def shown(p: _Piece) -> str:
        kept = p.kept and not (p.yields and p.text.lower() in rules.force_tokens)
        return p.text if not p.word or kept or not _latin(p.text) else transliterate(p.text)

    return "".join(map(shown, pieces))


def normalized(c: Column | str, rules: Rules = Rules()) -> Column:  # noqa: B008
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: normalize(t, rules))

    return run(F.col(c) if isinstance(c, str) else c)


def normalize_titles(df: DataFrame, title: str, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """``df`` with ``title`` normalized, ``title_original`` and ``title_changed``.  Python sees each
    distinct title once; titles without a Latin letter, entity or underscore stay in the JVM."""
    suspect = F.col(title).rlike(r"[A-Za-z&_]|\p{Cf}|^(?:['\"‘’“”„«»]|\d+\.\[)")
    distinct = df.filter(suspect).select(F.col(title).alias("_t")).distinct()
    found = distinct.select("_t", normalized("_t", rules).alias("_n"))
    out = df.join(found, df[title] == F.col("_t"), "left")
    rest = [df[c] for c in df.columns if c != title]
    new = F.coalesce("_n", F.col(title))
    return out.select(*rest, new.alias(title), F.col(title).alias("title_original"), (~new.eqNullSafe(F.col(title))).alias("title_changed"))


#: Kinds of a rule table and the fields that they fill.
_KINDS = {"protected_exact": "protected_exact", "protected_ci": "protected_ci", "protected_substring": "protected_substrings", "force_token": "force_tokens", "force_phrase": "force_phrases"}


def rules_of(table: DataFrame, **cleanups: bool) -> Rules:
    """Rules from a control table (kind, value), see ``quality.title_rule_rules``; it is small and
    is read by the driver."""
    held: dict[str, list[str]] = {f: [] for f in _KINDS.values()}
    for row in table.select("kind", "value").collect():
        value = row["value"] if row["kind"] == "protected_exact" else " ".join(row["value"].lower().split())
        held[_KINDS[row["kind"]]].append(value)
    plain = ("protected_substrings", "force_phrases")
    return Rules(**{f: tuple(sorted(v)) if f in plain else frozenset(v) for f, v in held.items()}, **cleanups)
