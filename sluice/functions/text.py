"""Folding, titles, handles, addresses and cursors as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that no decomposition leads from.
_PLAIN = {"ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i", "ё": "е"}
_PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
_BASES = {chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0x3B1, 0x3CA))}


def _accents() -> tuple[str, str, dict[str, str]]:
    """Lower-case letters that decompose to one letter a-z or α-ω, these letters, and the ligatures that decompose to several.

    Marks go with any letter of the basic plane; what the decomposition of a
    letter of another script gives stays as it is.
    """
    one, several = {}, {}
    for c in map(chr, range(0xC0, 0xFFF0)):
        if c != c.lower() or not c.isalpha():
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and base and set(base) <= _BASES:
            (one if len(base) == 1 else several)[c] = base
    one |= _PLAIN
    return "".join(one), "".join(one.values()), several | _PAIRS


ACCENTED, PLAIN, LIGATURES = _accents()


def fold(text: Column) -> Column:
    """Lower case without punctuation, white space and accents; symbols outside ASCII stay."""
    return _unaccent(F.lower(F.regexp_replace(text, r"[\p{Punct}\p{P}\p{Z}\t-\r]+", "")))


def _unaccent(lowered: Column) -> Column:
    # combining marks that stand by themselves go, too; ASCII texts need none of this
    plain = F.translate(F.regexp_replace(lowered, r"[\u0300-\u036f]", ""), ACCENTED, PLAIN)
    plain = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), LIGATURES.items(), plain)
    return F.when(lowered.rlike(r"[^\x00-\x7f]"), plain).otherwise(lowered)


def _unaccent_sql(lowered: str) -> str:
    plain = f"translate(regexp_replace({lowered}, '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), '{ACCENTED}', '{PLAIN}')"
    return reduce(lambda x, p: f"replace({x}, '{p[0]}', '{p[1]}')", LIGATURES.items(), plain)


def fold_sql(text: str) -> str:
    return _unaccent_sql(f"lower(regexp_replace({text}, '[[:punct:]\\p{{P}}\\p{{Z}}\\t-\\r]+', '', 'g'))")


def folded_equal(left: Column, right: Column) -> Column:
    """Whether both fold to the same text; what folds to nothing equals nothing."""
    return (fold(left) == fold(right)) & (fold(left) != "")


def tokens(query: str) -> list[str]:
    """White-space separated parts of a search that have more than punctuation."""
    return [t for t in query.split() if any(unicodedata.category(c)[0] not in "PZ" for c in t)]


def strip_article(name: Column) -> Column:
    """Sort key of a title: lower case without a leading article."""
    return F.regexp_replace(F.lower(name), r"^(the|a|an) +", "")


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def image_url(path: Column, kind_size: str, base: str = "https://images.example/t/p") -> Column:
    """base/size/path; null and blank paths give null."""
    trimmed = F.trim(path)
    return F.when(trimmed != "", F.concat_ws("/", F.lit(base), F.lit(kind_size), F.ltrim(trimmed, F.lit("/"))))


_SHORT, _LONG = 3, 30
# Names that no account may have, unless a caller gives a list of their own.
RESERVED = ["admin", "administrator", "api", "help", "me", "null", "root", "support", "system", "user"]
_MARKS = r"[\p{Punct}\p{P}\p{Z}\t-\r]+"


def handle_stem(name: Column, key: Column, reserved: list[str] = RESERVED) -> Column:
    """A handle from a name: folded to [a-z0-9_], beginning with a letter, 30 characters at most; else user_ and 8 digits of the key's hash."""
    plain = _unaccent(F.lower(F.regexp_replace(name, _MARKS, "_")))
    stem = F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9_]", ""), r"^[^a-z]+", "")
    stem = F.trim(F.substring(stem, 1, _LONG), F.lit("_"))
    unfit = (F.length(stem) < _SHORT) | stem.isin(reserved) | stem.rlike(r"^user_[0-9a-f]{8}$") | stem.isNull()
    return F.when(unfit, F.concat(F.lit("user_"), F.substring(F.md5(key.cast("string")), 1, 8))).otherwise(stem)


def handle_stem_sql(name: str, key: str, reserved: list[str] = RESERVED) -> str:
    plain = _unaccent_sql(f"lower(regexp_replace({name}, '[[:punct:]\\p{{P}}\\p{{Z}}\\t-\\r]+', '_', 'g'))")
    stem = f"trim(substr(regexp_replace(regexp_replace({plain}, '[^a-z0-9_]', '', 'g'), '^[^a-z]+', ''), 1, {_LONG}), '_')"
    names = ", ".join(f"'{x}'" for x in reserved)
    other = f"'user_' || substr(md5(CAST({key} AS VARCHAR)), 1, 8)"
    return f"CASE WHEN length({stem}) < {_SHORT} OR {stem} IN ({names}) OR regexp_matches({stem}, '^user_[0-9a-f]{{8}}$') OR {stem} IS NULL THEN {other} ELSE {stem} END"


def valid_handle(handle: Column, reserved: list[str] = RESERVED) -> Column:
    """Whether a handle, less a leading @, has the permitted form and isn't reserved."""
    bare = F.regexp_replace(F.trim(F.lower(handle)), "^@", "")
    return bare.rlike(r"^[a-z][a-z0-9_]{2,29}$") & ~bare.isin(reserved)


def email_shaped(name: Column) -> Column:
    return name.rlike(r"[^\s@]@[^\s@]*\.[^\s@]")


def rewrite_email_shaped(name: Column, key: Column) -> Column:
    """A display name that looks like an address becomes its part before the @, or User and 8 digits of the key's hash."""
    local = F.trim(F.split_part(name, F.lit("@"), F.lit(1)))
    return F.when(email_shaped(name), F.when(local != "", local).otherwise(F.concat(F.lit("User "), F.substring(F.md5(key.cast("string")), 1, 8)))).otherwise(name)


def encode_cursor(*parts: Column) -> Column:
    """An opaque page cursor: URL-safe base64, without padding, of the parts joined by bars."""
    return F.rtrim(F.translate(F.base64(F.concat_ws("|", *parts).cast("binary")), "+/", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """The parts of a cursor as an array."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.split(F.unbase64(padded).cast("string"), r"\|")


# Closing quotation marks, each with the one that opens it.
QUOTES = {"'": "'", '"': '"', "’": "‘", "”": "“"}
_DELIMITERS = "".join(dict.fromkeys("".join(c + o for c, o in QUOTES.items())))


def quoted_candidate(title: Column) -> Column:
    """The quoted part of a title whose last quotation mark closes: what lies between it and the nearest mark before that opens it.

    Marks of other kinds may lie within. Null where there is no such part or a blank one.
    """
    last = F.regexp_extract(title, f"([{_DELIMITERS}])[^{_DELIMITERS}]*$", 1)
    inner = F.lit(None).cast("string")
    for closer, opener in QUOTES.items():
        part = F.regexp_extract(title, f"(?s)^.*{opener}(.*){closer}[^{_DELIMITERS}]*$", 1)
        inner = F.when(last == closer, part).otherwise(inner)
    return F.nullif(F.regexp_replace(inner, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))
