"""Text hygiene as column expressions: character classes, cleaning, cutting, tokens.

The classes and their order of treatment are fixed values of the data contract; they are written with numeric escapes so
that this file holds no invisible characters.
"""

from __future__ import annotations

import json
import string
import unicodedata
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character classes of the audit, as patterns that Java and RE2 both read.
CLASSES = {
    "ZW": r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]",
    "BIDI": r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]",
    "C0": r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]",
    "C1": r"[\x{80}-\x{9F}]",
    "NBSP": r"\x{A0}",
    "LSEP": r"[\x{2028}\x{2029}\x{85}]",
    "SHY": r"\x{AD}",
    "PUA": r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}]",
    "VS": r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]",
    "TAGS": r"[\x{E0000}-\x{E007F}]",
    "FFFD": r"\x{FFFD}",
    "NONCHAR": r"[\x{FFF0}-\x{FFF8}\x{FFFE}\x{FFFF}]",
    "MOJI": r"(?:[\x{C2}-\x{C5}][\x{80}-\x{BF}\x{152}-\x{192}\x{2013}-\x{203A}\x{2C6}\x{2DC}\x{2122}\x{20AC}]|\x{E2}\x{20AC}|\x{EF}\x{BF}\x{BD})",
    "HTMLENT": r"&(?:[a-zA-Z]{2,8}|#[0-9]{2,6}|#x[0-9a-fA-F]{2,5});",
    "ESCSEQ_X000D": r"_x000D_",
    "HTMLTAG": r"</?[a-zA-Z][a-zA-Z0-9:]{0,20}(?:[\x20\x09-\x0D][^<>]{0,200})?/?>",
    "CYR": r"[\x{400}-\x{4FF}]",
    "CJK": r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]",
    "RTL": r"[\x{590}-\x{6FF}\x{E00}-\x{E7F}]",
    "DBLSP": r" {2,}",
    "WS_EDGE": r"(?:^[\x20\x09-\x0D]|[\x20\x09-\x0D]$)",
}
CRITICAL = ("ZW", "BIDI", "C0", "C1", "PUA", "VS", "TAGS", "NONCHAR", "FFFD", "MOJI", "ESCSEQ_X000D")
#: The named references of HTML5 as they follow an ampersand, most with a semicolon, some older ones also without.
ENTITIES = dict(html5)
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
# What cleaning removes, what it turns into a space, and sequences that no decoding repairs.
REMOVED = r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x00-\x08\x0E-\x1F\x7F\x{80}-\x{84}\x{86}-\x{9F}\x{AD}\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}\x{FE00}-\x{FE0F}\x{E0000}-\x{E01EF}\x{FFFD}\x{FFF0}-\x{FFF8}\x{FFFE}\x{FFFF}]"
TO_SPACE = r"(?:_x000D_|[\x{A0}\x{2028}\x{2029}\x{85}\x0B\x0C\x09\x0D])"
KNOWN_BROKEN = {"Ã¢ÂÂ¢": "™"}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows_1252(codes: Column) -> Column:
    """The characters of Windows-1252 for numbers from 128 to 159; those that it leaves open stay control characters."""
    at = (codes - 127).cast("int")
    return F.substring(F.lit("".join(PAGES[0].chars[:32])), at, F.lit(1))


def _numbered(digits: Column, base: int) -> Column:
    """The character of a numeric reference: Windows-1252 below 160, nothing for control and non-characters, U+FFFD beyond Unicode."""
    short = F.ltrim(digits, F.lit("0"))
    code = F.when(F.length(short) > 7, F.lit(1 << 30)).otherwise(F.conv(F.concat(F.lit("0"), short), base, 10).cast("int"))

    def of(c: Column) -> Column:
        empty = c.between(1, 8) | c.between(14, 31) | c.isin(11, 127) | c.between(0xFDD0, 0xFDEF) | (c % 0x10000 >= 0xFFFE)
        return (
            F.when((c == 0) | (c > 0x10FFFF) | c.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .when(c.between(128, 159), _windows_1252(c))
            .when(empty, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))
        )

    return let(code, of)


def _referenced(piece: Column) -> Column:
    """What followed an ampersand, with the reference that it begins with, if any, as characters."""
    # by first letter, as a lookup goes through a map from its beginning; folded into one constant
    known = F.from_json(F.lit(json.dumps([{n: v for n, v in ENTITIES.items() if ord(n[0]) == k} for k in range(65, 123)])), "array<map<string,string>>")
    value = lambda n: F.when(F.ascii(n).between(65, 122), F.try_element_at(F.element_at(known, F.ascii(n) - 64), n))
    decimal, hexadecimal = F.regexp_extract(piece, "^#([0-9]+);?", 1), F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+);?", 1)
    after = lambda pattern: F.regexp_replace(piece, pattern, "")
    name, bare = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0), F.regexp_extract(piece, f"^(?:{_BARE})", 0)
    cut = lambda found: F.substring(piece, F.length(found) + 1, F.length(piece))
    named = let(name, lambda n: F.concat(value(n), cut(n)))
    older = let(bare, lambda n: F.concat(value(n), cut(n)))
    return (
        F.when(decimal != "", F.concat(_numbered(decimal, 10), after("^#[0-9]+;?")))
        .when(hexadecimal != "", F.concat(_numbered(hexadecimal, 16), after("^#[xX][0-9a-fA-F]+;?")))
        .otherwise(F.coalesce(named, older, F.concat(F.lit("&"), piece)))
    )


def _unescape_once(text: Column) -> Column:
    pieces = F.split(text, "&", -1)
    later = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), _referenced)
    return F.when(F.contains(text, F.lit("&")), F.concat(pieces[0], F.array_join(later, ""))).otherwise(text)


def unescape(text: Column, rounds: int = 4) -> Column:
    """References to characters by the rules of HTML5, repeated for double escapes; each round is one pass over the pieces
    between ampersands: numbers with or without a semicolon, full names, else the longest of the older names."""
    again = lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), t, lambda s, _: _unescape_once(s))
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), again(t)).otherwise(t))


@dataclass(frozen=True)
class Page:
    """A code page as text that went through it shows UTF-8: the characters for the bytes 128 to 255, and the sequences that
    are looked for."""

    name: str

    @property
    def chars(self) -> list[str]:
        """Bytes that the page leaves open are taken as control characters, as decoders in the wild do."""
        return [bytes([b]).decode(self.name, "ignore") or chr(b) for b in range(128, 256)]

    def some(self, low: int, high: int, but: str = "") -> str:
        """A class of the characters of some bytes; control characters also stand for themselves, as in Latin-1."""
        controls = [chr(b) for b in range(low, min(high, 0x9F) + 1)]
        return "[" + "".join(rf"\x{{{ord(c):X}}}" for c in dict.fromkeys([*self.chars[low - 128 : high - 127], *controls]) if c not in but) + "]"

    @property
    def sequences(self) -> str:
        """UTF-8 of two to four bytes. Of two-byte leads, the four of the class are taken alone if the page shares them
        with Latin-1, or before what is no closing mark; others only in a row, as letters of their own also stand alone."""
        go_on, marks = self.some(0x80, 0xBF), "‘’“”‚„«»‹›…–—"
        shared = "".join(c for c in self.chars[0x42:0x46] if c == chr(128 + self.chars.index(c)))
        own = "".join(c for c in self.chars[0x42:0x46] if c not in shared)
        alone = [f"[{shared}]{go_on}"] + ([f"[{own}]{self.some(0x80, 0xBF, marks)}"] if own else [])
        leads = self.some(0xC2, 0xF4)
        twice = {f"{chr(0xC0 | ord(c) >> 6)}{self.chars[(ord(c) & 63)]}": c for c in self.chars[:32] if 0x180 <= ord(c) < 0x800}  # the page's own letters
        return rf"(?=[^\x00-\x7F])(?={leads})(?:" + "|".join([*alone, *(twice if self.name == "cp1252" else ()), f"(?:{self.some(0xC6, 0xDF)}{go_on}){{2,}}", f"{self.some(0xE0, 0xEF)}{go_on}{{2}}", f"{self.some(0xF0, 0xF4)}{go_on}{{3}}"]) + ")"

    def decoded(self, found: Column) -> Column:
        """The text whose UTF-8 a sequence is; the sequence itself if it is none."""
        odd = [(c, chr(128 + k)) for k, c in enumerate(self.chars) if c != chr(128 + k)]
        raw = F.encode(F.translate(found, "".join(c for c, _ in odd), "".join(c for _, c in odd)), "ISO-8859-1")
        return F.coalesce(F.try_validate_utf8(raw.cast("string")), found)


#: Windows-1252, whose first 160 characters also stand for what Latin-1 shows, then the page of Central Europe.
PAGES = (Page("cp1252"), Page("cp1250"))
#: A no-break space within a sequence that has become a space: ``à`` before a word, or one byte of two or three.
_LOST_SPACE = {
    r"\x{C3} (?! |quele|quela|quilo|s )": "\xc3\xa0 ",
    r"([\x{C2}\x{C3}\x{C5}\x{CE}\x{D0}\x{D9}]) ": "$1\xa0",
    r"(\x{E2}[\x{80}\x{20AC}]) ": "$1\xa0",
}
#: A sequence of which a byte was replaced when it went through the page; it cannot be restored.
_LOST_BYTE = rf"[\x{{C2}}-\x{{DF}}]\x{{FFFD}}|[\x{{E0}}-\x{{EF}}](?:{PAGES[0].some(0x80, 0xBF)}\x{{FFFD}}|\x{{FFFD}}{PAGES[0].some(0x80, 0xBF)})"


def _decoded_runs(page: Page):
    def of(text: Column) -> Column:
        found, between = F.regexp_extract_all(text, F.lit(page.sequences), 0), F.split(text, page.sequences, -1)
        pieces = F.zip_with(between, found, lambda b, f: F.concat(b, F.coalesce(page.decoded(f), F.lit(""))))
        return F.when(text.rlike(page.sequences), F.array_join(pieces, "")).otherwise(text)

    return of


def repair_mojibake(text: Column, rounds: int = 4) -> Column:
    """UTF-8 that was read as Windows-1252 or Windows-1250, each sequence for itself, so that sound text beside it stays.

    Text that went that way more than once takes as many rounds. In a text that shows such sequences, those that lost a
    no-break space to a space are restored and those that lost a byte go; elsewhere ``Ã`` before a space is a letter.
    """

    def once(s: Column) -> Column:
        restored = F.regexp_replace(s, _LOST_BYTE, "\ufffd")
        for pattern, repaired in _LOST_SPACE.items():
            restored = F.regexp_replace(restored, pattern, repaired)
        s = F.when(s.rlike(PAGES[0].sequences) | s.rlike(_LOST_BYTE), restored).otherwise(s)
        for page in PAGES:
            s = let(s, _decoded_runs(page))
        return s

    shown = rf"(?=[^\x00-\x7F])(?:{'|'.join([*[page.sequences for page in PAGES], _LOST_BYTE])})"
    again = lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), t, lambda s, _: F.when(s.rlike(shown), let(s, once)).otherwise(s))
    # a text without such a sequence is looked through once, one in ASCII not at all
    return let(text, lambda t: F.when((F.octet_length(t) > F.length(t)) & t.rlike(shown), again(t)).otherwise(t))


def control_characters(text: Column) -> Column:
    """Control characters that stand for Windows-1252 become its characters; terminal colours and moves go."""
    odd = [(chr(128 + k), c) for k, c in enumerate(PAGES[0].chars[:32]) if c != chr(128 + k)]
    return F.regexp_replace(F.translate(text, "".join(c for c, _ in odd), "".join(c for _, c in odd)), r"\x1B\[[0-9;]*[A-Za-z]", "")


def strip_html(text: Column) -> Column:
    """TXT2: script and style blocks, then tags, each to one space."""
    for tag in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return F.regexp_replace(text, CLASSES["HTMLTAG"], " ")


def tidy(text: Column) -> Column:
    """Invisible characters out, odd white space to spaces, runs to one, edges off; nothing readable is null."""
    text = F.regexp_replace(F.regexp_replace(text, REMOVED, ""), TO_SPACE, " ")
    return F.nullif(F.trim(F.regexp_replace(text, " {2,}", " ")), F.lit(""))


def clean_text(text: Column, html: bool = False) -> Column:
    """TXT1: unescape, known broken sequences, mojibake, control characters, unescape again, optional tags, tidy."""
    out = unescape(text)
    for broken, fixed in KNOWN_BROKEN.items():
        out = F.replace(out, F.lit(broken), F.lit(fixed))
    out = unescape(control_characters(repair_mojibake(out)))
    return tidy(strip_html(out) if html else out)


def first_hit(text: Column, name: str, around: int = 20) -> Column:
    """The first occurrence of a class with ``around`` characters on either side; null where there is none."""
    at = F.length(F.split(text, CLASSES[name], 2)[0]) + 1
    return F.when(text.rlike(CLASSES[name]), let(at, lambda k: F.substring(text, F.greatest(k - around, F.lit(1)), F.lit(2 * around + 1))))


def class_counts(text: Column) -> Column:
    """TXT3: map from class to occurrences; classes that do not occur are left out."""
    pairs = [x for name, pattern in CLASSES.items() for x in (F.lit(name), F.regexp_count(text, F.lit(pattern)))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def audit(df: DataFrame, name: str) -> DataFrame:
    """TXT4: class counts summed over all string columns of a table, with severity."""
    columns = [c for c, kind in df.dtypes if kind == "string"]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])).alias("x")).select("x.*")
    found = long.select("column_name", F.explode(class_counts(F.col("value"))).alias("class", "n"))
    summed = found.groupBy("column_name", "class").agg(F.sum("n").cast("long").alias("n"))
    return summed.select(F.lit(name).alias("table_name"), "column_name", "class", "n", F.when(F.col("class").isin(*CRITICAL), "critical").otherwise("info").alias("severity"))


def stage_trace(df: DataFrame, key: str, text: str) -> DataFrame:
    """TXT6: ``stage, class, n, key, example`` for the stages raw, unescaped and clean: occurrences of each class, and the
    smallest key whose text has it, with the surroundings of the first one there."""
    value = F.col(text)
    stages = [F.struct(F.lit(n).alias("stage"), c.alias("v")) for n, c in (("raw", value), ("unescaped", unescape(value)), ("clean", clean_text(value)))]
    long = df.select(F.col(key).alias("key"), F.explode(F.array(*stages)).alias("s")).select("key", "s.stage", "s.v")
    hits = [F.when(F.regexp_count("v", F.lit(CLASSES[c])) > 0, F.struct(F.lit(c).alias("class"), F.regexp_count("v", F.lit(CLASSES[c])).alias("n"), first_hit(F.col("v"), c).alias("example"))) for c in CLASSES]
    found = long.select("key", "stage", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("key", "stage", "h.*")
    summed = found.groupBy("stage", "class").agg(F.sum("n").cast("long").alias("n"), F.min(F.struct("key", "example")).alias("first"))
    return summed.select("stage", "class", "n", "first.key", "first.example")


def cut_at_word(text: Column, limit: int, ellipsis: bool = False) -> Column:
    """TXT9: at most ``limit`` characters without a torn word."""
    head = F.regexp_replace(F.substring(text, 1, limit), r"[\x20\x09-\x0D][^\x20\x09-\x0D]*\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit("…")) if ellipsis else head)


def normal_quote(text: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(text, r"[\x{22}\x{27}\x{AB}\x{BB}\x{2018}-\x{201F}]", ""), r"[\x20\x09-\x0D]+", " ")
    return F.rtrim(F.lower(F.trim(flat)), F.lit(".,!?;: "))


def quote_found(quote: Column, text: Column) -> Column:
    """TXT10: whether the normalised quote occurs in the normalised text; an empty quote is not found."""
    q = normal_quote(quote)
    return (q != "") & F.contains(normal_quote(text), q)


def _plain(c: str) -> str:
    """A character's compatibility decomposition in lower case, its letters and digits of ASCII only."""
    return "".join(x for x in unicodedata.normalize("NFKD", c).lower() if x in string.ascii_lowercase + string.digits)


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """All characters of Unicode that decompose to plain ones: those with one, by itself, and those with several."""
    found = {c: _plain(c) for c in map(chr, range(0xA0, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.decomposition(c)}
    return {c: x for c, x in found.items() if len(x) == 1}, {c: x for c, x in found.items() if len(x) > 1}


def ascii_fold(text: Column) -> Column:
    """TXT12: lower case without diacritics, letters and digits of ASCII only, by Unicode's decompositions."""
    single, several = _folds()
    others = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(others, c), c)), "")
    wide = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in several) + "]"
    text = F.when(text.rlike(rf"(?=[^\x00-\x7F]){wide}"), spelt).otherwise(text)
    folded = F.translate(text, "".join(single) + string.ascii_uppercase, "".join(single.values()) + string.ascii_lowercase)
    return F.regexp_replace(folded, "[^a-z0-9]", "")


TOKEN_PATTERNS = {"search": "[A-Za-zÁ-ž0-9]{2,}", "frequent": "[a-zá-žäöü][a-zá-ž0-9]{2,}", "style": "[a-záčďéěíňóřšťúůýž]+"}


def tokens(text: Column, kind: str) -> Column:
    """TXT13: tokens of one of three kinds."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERNS[kind]), 0)


def clean_nested(df: DataFrame, column: str) -> DataFrame:
    """TXT5: every string leaf of a nested column cleaned; keys stay."""
    from pyspark.sql import types as T

    def walk(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return clean_text(value)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, x: walk(x, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*[walk(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return value

    return df.withColumn(column, walk(F.col(column), df.schema[column].dataType))
