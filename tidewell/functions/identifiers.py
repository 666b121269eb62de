"""Identifier shapes, checksums and name keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier shapes.
SHAPES = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "PHONE": r"(?:\+420[\s.]*)?(?:\d{3}[\s.]*){2}\d{3}\b",
    "PHONE_BARE9": r"\b[2-79]\d{2}\s?\d{3}\s?\d{3}\b",
    "RC": r"\b\d{6}/\d{3,4}\b",
    "DIC": r"(?i)\bCZ\d{8}\b",
    "ICO": r"\b\d{8}\b",
    "IBAN_CZ": r"(?i)\bCZ\d{2}(?:\s?\d{4}){5}\b",
    "BBAN": r"\b(?:\d{1,6}-)?\d{2,10}/\d{4}\b",
    "PSC": r"\b\d{3}\s?\d{2}\b",
}
#: What a text needs to have for a shape to be in it; a digit, if not named.
NEEDED = {"EMAIL": "@"}
# Surname endings, longest first, with their paradigm.
ENDINGS = (
    ("ovou", "f"), ("ové", "f"), ("ová", "f"), ("ého", "adj"), ("ému", "adj"), ("ým", "adj"), ("ém", "adj"), ("ovi", "m"), ("em", "m"),
    ("ou", "m"), ("ý", "adj"), ("á", "adj"), ("é", "adj"), ("a", "m"), ("e", "m"), ("u", "m"), ("y", "m"), ("i", "m"),
)


ENDING_PATTERN = "^(.{3,}?)(" + "|".join(e for e, _ in ENDINGS) + ")$"


def _digit(text: Column, k: int) -> Column:
    return F.substring(text, k, 1).try_cast("int")


def ico_ok(text: Column) -> Column:
    """PII2: eight digits, the last being (11 - weighted sum mod 11) mod 10."""
    d = F.regexp_replace(text, "[^0-9]", "")
    total = sum((_digit(d, k) * (9 - k) for k in range(2, 8)), _digit(d, 1) * 8)
    return (F.length(d) == 8) & F.coalesce(_digit(d, 8) == (11 - total % 11) % 10, F.lit(False))


def iban_ok(text: Column) -> Column:
    """PII3: CZ and 22 digits; the rearranged number leaves 1 modulo 97 (C is 12, Z is 35)."""
    raw = F.upper(F.regexp_replace(text, r"\s", ""))
    number = F.concat(F.substring(raw, 5, 20), F.lit("1235"), F.substring(raw, 3, 2)).try_cast("decimal(38,0)")
    return raw.rlike("^CZ[0-9]{22}$") & F.coalesce(number % 97 == 1, F.lit(False))


def birth_number_ok(text: Column) -> Column:
    """PII4: month bands 0, 20, 50, 70; a real day; modulo 11 with the exception of remainder 10; nine digits have no
    check digit and may be a 29 February of any year."""
    d = F.replace(text, F.lit("/"), F.lit(""))
    part = lambda a, n: F.substring(d, a, n).try_cast("int")
    yy, mm, dd = part(1, 2), part(3, 2), part(5, 2)
    month = F.when(mm.between(1, 12), mm).when(mm.between(21, 32), mm - 20).when(mm.between(51, 62), mm - 50).when(mm.between(71, 82), mm - 70)
    date = lambda year: F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, dd)).isNotNull()
    remainder = (F.substring(d, 1, 9).try_cast("long") % 11).cast("int")
    long = date(F.when(yy >= 54, 1900 + yy).otherwise(2000 + yy)) & (_digit(d, 10) == F.when(remainder == 10, 0).otherwise(remainder))
    short = date(F.lit(2000))
    ok = F.when(F.length(d) == 10, long).when(F.length(d) == 9, short)
    return d.rlike("^[0-9]{9,10}$") & month.isNotNull() & F.coalesce(ok, F.lit(False))


def _fleeting(stem: Column) -> Column:
    """Without the e of a final -ek or -el after a consonant."""
    return F.regexp_replace(stem, "^(.+[^aeiouáéíóúůy])e([kl])$", "$1$2")


def surname_key(word: Column) -> Column:
    """PII9: struct of stem and paradigm of a surname in any case: the longest ending that leaves three letters goes."""
    low = F.lower(word)
    stem = _fleeting(F.coalesce(F.nullif(F.regexp_extract(low, ENDING_PATTERN, 1), F.lit("")), low))
    ending = F.regexp_extract(low, ENDING_PATTERN, 2)
    of = lambda kind: [e for e, k in ENDINGS if k == kind]
    return F.struct(stem.alias("stem"), F.when(ending.isin(of("f")), "f").when(ending.isin(of("adj")), "adj").otherwise("m").alias("kind"))


def entity_key(pii_type: Column, surface: Column) -> Column:
    """One text per entity: a person by stem and paradigm of the last word, anything else by its collapsed form."""
    flat = F.trim(F.regexp_replace(surface, r"\s+", " "))
    key = surname_key(F.element_at(F.split(flat, " "), -1))
    return F.when(pii_type == "PERSON", F.concat_ws("|", pii_type, key["stem"], key["kind"])).otherwise(F.concat_ws("|", pii_type, flat))


def name_match(word: Column, name: Column) -> Column:
    """FLT3: 4 equal, 3 substring, 2 same surname key, 1 shared prefix with short endings, 0 none."""
    w, n = F.lower(word), F.lower(name)
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(w), F.length(n)), F.lit(1))), F.lit(0), lambda s, k: F.when((s == k - 1) & (w.substr(F.lit(1), k) == n.substr(F.lit(1), k)), k).otherwise(s))
    near = (shared >= 3) & (F.length(w) - shared <= 2) & (F.length(n) - shared <= 2)
    tiny = (shared == 2) & (F.length(w) <= 4) & (F.length(n) <= 4)
    score = F.when(w == n, 4).when(F.contains(n, w), 3).when(surname_key(w) == surname_key(n), 2).when(near | tiny, 1).otherwise(0)
    return F.when((F.coalesce(w, F.lit("")) == "") | (F.coalesce(n, F.lit("")) == ""), 0).otherwise(score)
