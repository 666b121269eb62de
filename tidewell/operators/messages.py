"""Messages: template fill, rule verdicts, routing, style measures, categories."""

from __future__ import annotations

import functools
import string
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Function-word classes of the style measure (per language of the corpus), categories and their stems.
STYLE = {
    "pronouns": ("he", "she", "it", "they", "il", "elle", "er", "sie", "es", "lo", "se"),
    "articles": ("the", "a", "an", "der", "die", "das", "le", "la", "les", "el", "los", "las", "un", "une", "una"),
    "prepositions": ("of", "in", "to", "with", "at", "by", "for", "de", "en", "dans", "von", "mit", "zu", "con", "por"),
    "conjunctions": ("and", "or", "but", "und", "oder", "et", "ou", "y", "que"),
    "auxiliary": ("is", "was", "are", "be", "ist", "war", "est", "son", "es"),
    "negations": ("no", "not", "nicht", "ne", "pas"),
    "quantifiers": ("all", "some", "many", "alle", "tous", "todos"),
}
CATEGORIES = (
    ("complaint", ("bad", "broken", "refund", "toxic")),
    ("delivery", ("address", "delivery", "ship", "mail")),
    ("follow_up", ("follow", "callback", "meeting", "call")),
    ("sales", ("discount", "quote", "offer", "sale")),
    ("support", ("support", "warrant", "help", "license")),
)
INFORMAL = (" you ", " your ", " tu ", " du ")
FORMAL = ("sir", "madam", "monsieur", "sie")
# marks of instructions, each with how it goes on; all begin a word, as "pas an ai" is no mark
BLEED = {"ignore previous": "", "system prompt": "", "as an ai": r"(?![\p{L}\p{N}])", "instructions:": ""}


def style_proportions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Share of each function-word class among a text's tokens; no shuffle."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), 0)
    staged = texts.withColumn("_w", words)
    share = lambda ws: F.when(F.size("_w") == 0, 0.0).otherwise(F.size(F.filter("_w", lambda w: w.isin(*ws))) / F.size("_w"))
    return staged.select(key, F.struct(*[share(ws).alias(c) for c, ws in STYLE.items()]).alias("style"))


def style_match(a: Column, b: Column) -> Column:
    """VAL8: mean over the classes of 1 - |pa - pb| / (pa + pb); 1 where both are 0."""
    per = [F.when(a[c] + b[c] == 0, 1.0).otherwise(1 - F.abs(a[c] - b[c]) / (a[c] + b[c])) for c in STYLE]
    return sum(per[1:], per[0]) / len(per)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zà-ÿ0-9]+"), 0))


def jaccard(a: Column, b: Column) -> Column:
    """SET6: shared over all members; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def fill(template: Column, swaps: dict[str, str]) -> Column:
    """VAL1: a fold of literal replacements over a template."""
    for old, new in swaps.items():
        template = F.replace(template, F.lit(old), F.lit(new))
    return template


# Czech words by which a message agrees with its addressee.
AUXILIARIES = "jste|jsi|ses|sis"
FILLERS = "to|si|se|už|ještě|právě|zatím|nedávno|dnes|teď|také|taky|zcela|docela|velmi|opravdu|moc|skutečně|naprosto|vždy|stále"
NO_PARTICIPLES = ("zcela", "docela", "dokola", "zdola", "zpola", "zhola", "dál", "půl", "cíl")
PREDICATES = "spokojen|zařazen|vybrán|zvolen|pozván|nadšen|vítán|přihlášen|oceněn|odměněn|zaregistrován|registrován|zapsán|rád|sám|jist|připraven|povinen|oprávněn|přesvědčen"
ROLES = {
    "m": "zákazník|zákazníka|zákazníkovi|zákazníkem|zákazníku|klient|klienta|klientovi|klientem|kliente|člen|člena|členovi|členem|člene|uživatel|uživatele|uživateli|uživatelem|partner|partnera|partnerovi|partnerem|partnere|majitel|majitele|majiteli|majitelem",
    "f": "zákaznice|zákaznici|zákaznicí|klientka|klientku|klientkou|klientce|klientko|členka|členku|členkou|člence|členko|uživatelka|uživatelku|uživatelkou|uživatelce|uživatelko|partnerka|partnerku|partnerkou|partnerce|partnerko|majitelka|majitelku|majitelkou|majitelce",
}
ROLE_FRAMES = "jako|jste|jsi|náš|naše|naší|našeho|našemu|naším|milý|milá|věrný|věrná|vážený|vážená|loajální|stálý|stálá|drahý|drahá"
ADJECTIVES = {"m": "milý|věrný|vážený|stálý|drahý|spokojený|nadšený|registrovaný|přihlášený", "f": "milá|věrná|vážená|stálá|drahá|spokojená|nadšená|registrovaná|přihlášená"}
TAGS = r"</?(?:system|developer|instruction|prompt)[^>]*>"


def gender_sites(text: Column) -> Column:
    """The words by which a message agrees with its addressee, with the gender they imply (m, f, or n for a plural).

    Five kinds in turn: participles after and before an auxiliary, short predicates, the addressee's role noun, and the
    adjective on it.
    """
    flat, low = F.replace(text, F.lit("\n"), F.lit(" ")), F.lower
    filler, any_role = rf"(?:(?:{FILLERS})\s+){{0,2}}", "|".join(ROLES.values())
    words = lambda pattern: F.regexp_extract_all(flat, F.lit(f"(?iU){pattern}"), 1)
    participle = lambda w: F.when(low(w).endswith("la"), "f").when(low(w).rlike("l[iy]$"), "n").otherwise("m")
    one_of = lambda forms: lambda w: F.when(low(w).rlike(f"^(?:{forms})$"), "f").otherwise("m")
    found = [
        (words(rf"\b(?:{AUXILIARIES})\s+{filler}(?:byl[ai]?\s+)?(\w+?l[aiy]?)\b"), participle, NO_PARTICIPLES),
        (words(rf"\b(\w+?l[aiy]?)\s+(?:{AUXILIARIES})\b"), participle, NO_PARTICIPLES),
        (words(rf"\b(?:{AUXILIARIES}|byla?)\s+{filler}((?:{PREDICATES})a?)\b"), lambda w: F.when(low(w).endswith("a"), "f").otherwise("m"), ()),
        (words(rf"\b(?:{ROLE_FRAMES})\s+(?:\w+\s+){{0,2}}?((?:{any_role}))\b"), one_of(ROLES["f"]), ()),
        (words(rf"\b((?:{'|'.join(ADJECTIVES.values())}))\s+(?:{any_role})\b"), one_of(ADJECTIVES["f"]), ()),
    ]
    site = lambda gender: lambda w: F.struct(w.alias("word"), gender(w).alias("gender"))
    kept = [F.transform(F.filter(ws, lambda w: ~low(w).isin(*no)) if no else ws, site(gender)) for ws, gender, no in found]
    return F.concat(*kept)


def rule_verdict(text: Column, greeting: Column, formal: Column, gender: Column, prices: Column) -> Column:
    """VAL3: struct of the single checks; a null field leaves its check out and, but for prices, names it in ``unchecked``.

    ``gender`` is m or f, ``prices`` the texts of an offer, all of which the message has to hold whatever its white space
    and case; ``bleed`` lists the marks of instructions and of their tags.
    """
    body = F.regexp_replace(text, r"^[^A-Za-zÀ-ÿ]+", "")
    low = F.concat(F.lit(" "), F.lower(F.regexp_replace(text, r"\s+", " ")), F.lit(" "))
    informal = F.exists(F.array(*map(F.lit, INFORMAL)), lambda m: F.contains(low, m))
    polite = F.exists(F.array(*map(F.lit, FORMAL)), lambda m: F.contains(low, F.concat(F.lit(" "), m, F.lit(" "))))
    marks = F.array_compact(F.array(*[F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}]){mark}{after}"), mark) for mark, after in BLEED.items()]))
    bleed = F.when(low.rlike(TAGS), F.array_append(marks, F.lit("tag"))).otherwise(marks)
    copies = (F.length(text) - F.length(F.replace(text, greeting, F.lit("")))) / F.length(greeting)
    known = F.when(gender.isin("m", "f"), gender)
    sites = gender_sites(text)
    flat = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    missing = F.filter(prices, lambda p: ~F.contains(flat(text), flat(p)))
    unchecked = F.array_compact(F.array(F.when(greeting.isNull(), "vocative"), F.when(formal.isNull(), "register"), F.when(known.isNull(), "gender")))
    return F.struct(
        F.coalesce(body.startswith(greeting), F.lit(True)).alias("vocative_ok"),
        F.coalesce(copies > 1, F.lit(False)).alias("duplicate"),
        F.when(formal.isNull(), True).when(formal, ~informal).otherwise(~polite).alias("register_ok"),
        F.array_join(bleed, ",").alias("bleed"),
        F.coalesce(F.forall(sites, lambda s: s["gender"].isin("n") | (s["gender"] == known)), F.lit(True)).alias("gender_ok"),
        F.array_join(F.transform(sites, lambda s: F.concat(s["word"], F.lit("="), s["gender"])), ",").alias("gender_sites"),
        F.coalesce(F.size(missing) == 0, F.lit(True)).alias("pricing_ok"),
        F.array_join(unchecked, ",").alias("unchecked"),
    )


def route(rules_ok: Column, first: Column, second: Column, arbiter: Column) -> tuple[Column, Column]:
    """VAL5: state and reason from the rules, two judges and an arbiter."""
    agree = first.eqNullSafe(second)
    final = F.when(agree, first).otherwise(arbiter)
    state = F.when(~rules_ok, "PARTIAL").when(first.isNull() & second.isNull(), "HUMAN").when(final.isNull(), "HUMAN").when(final, "VALID").otherwise("PARTIAL")
    reason = F.when(~rules_ok, "rules").when(first.isNull() & second.isNull(), "no verdict").when(agree, "judges agree").when(final.isNull(), "no arbiter").otherwise("arbiter")
    return state, reason


def evidence_status(evidence: Column, message: Column) -> Column:
    """VAL4: 'found' if every quoted fragment of the evidence is in the message, 'missing' if one is not, 'n/a' without any."""
    parts = F.filter(F.regexp_extract_all(evidence, F.lit('"([^"]*)"'), F.lit(1)), lambda x: F.trim(x) != "")
    return F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, "n/a").when(F.forall(parts, lambda x: F.contains(message, x)), "found").otherwise("missing")


def categorise(text: Column) -> Column:
    """VAL13: the category with the most matched stems, ties by name, with its confidence."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.struct((-F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w)))).alias("n"), F.lit(c).alias("name")) for c, ws in CATEGORIES]
    best = F.array_min(F.array(*hits))
    count = -best["n"]
    none = F.struct(F.lit("general").alias("category"), F.when(F.trim(low) == "", 0.0).otherwise(0.35).alias("confidence"))
    return F.when(count == 0, none).otherwise(F.struct(best["name"].alias("category"), F.round(F.least(F.lit(0.95), 0.55 + 0.15 * count), 2).alias("confidence")))


#: Small Latin letters with marks and the letters that they decompose to.
UNACCENTED = {c: base for c in map(chr, range(0xE0, 0x250)) if c == c.lower() and (base := unicodedata.normalize("NFD", c)[0]) in string.ascii_lowercase}


def term_index(docs: DataFrame, key: str, *columns: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """SRCH1: rows (term, key) of folded words over several text columns, with the columns ``kept``."""
    folded = F.translate(F.lower(F.concat_ws(" ", *columns)), "".join(UNACCENTED), "".join(UNACCENTED.values()))
    return docs.select(F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit("[a-z0-9]{2,}"), 0))).alias("term"), key, *kept)


def search(index: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """Keys that hold every word of a query. ``queries`` has query, word; a final ``*`` asks for a prefix.

    Exact words meet the index in an equi-join on the term, prefixes in one on the term's beginning, for which only
    beginnings of the lengths that are asked for are made.
    """
    asked = queries.withColumn("n", F.count("*").over(Window.partitionBy("query")))
    exact = asked.where("NOT word LIKE '%*'").join(index, F.col("word") == F.col("term")).select("query", "word", "n", key)
    prefixes = asked.where("word LIKE '%*'").withColumn("head", F.regexp_replace("word", r"\*$", ""))
    lengths = sorted(r["n"] for r in prefixes.select(F.length("head").alias("n")).distinct().collect())  # of the asked words only
    long_enough = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.length("term"))
    starts = index.withColumn("head", F.explode(F.transform(long_enough, lambda k: F.col("term").substr(F.lit(1), k))))
    begun = prefixes.join(starts, "head").select("query", "word", "n", key)
    found = exact.unionByName(begun).groupBy("query", key, "n").agg(F.countDistinct("word").alias("hits"))
    return found.where("hits = n").select("query", key)


def write_term_index(docs: DataFrame, key: str, columns: tuple[str, ...], kept: tuple[str, ...], folder: str) -> None:
    """SRCH1: the term index as Parquet in ``folder``, in ranges of term and key.

    Files are sorted, so their statistics leave those with a query's words to be read; a frequent term has several.
    """
    index = term_index(docs, key, *columns, kept=kept)
    index.repartitionByRange("term", key).sortWithinPartitions("term", key).write.parquet(folder)


def search_index(index: DataFrame, key: str, queries: dict[str, tuple[str, object]], newest: str, owner: str, limit: int = 10) -> DataFrame:
    """SRCH1: of each query, the ``limit`` newest keys that hold all its words; rows (query, key, newest, rank).

    ``queries`` gives words, folded like the index, and an owner or None; a final ``*`` of a word asks for a prefix. Words
    and prefixes are ranges of terms that reach the scan of a written index; texts are not read. Ties go to the larger
    key; a query without words finds nothing.
    """
    asked = []
    for name, (words, who) in queries.items():
        distinct = sorted({w.lower().translate(str.maketrans(UNACCENTED)) for w in words.split()})
        for k, w in enumerate(distinct):  # "!" is before, "~" after all that a term is made of
            asked.append((name, w.rstrip("*"), w.rstrip("*") + ("~" if w.endswith("*") else "!"), who, 1 << k, (1 << len(distinct)) - 1))
    ranges = [(F.col("term") >= lo) & (F.col("term") < hi) for _, lo, hi, *_ in asked]
    of = index.schema[owner].dataType
    hits = F.array_compact(
        F.array(*[F.when(r & (F.lit(who is None) | F.col(owner).eqNullSafe(F.lit(who).cast(of))), F.struct(F.lit(q).alias("query"), F.lit(bit).alias("bit"), F.lit(whole).alias("whole"))) for r, (q, _, _, who, bit, whole) in zip(ranges, asked, strict=True)])
    )
    if not asked:
        return index.where(F.lit(False)).select(F.lit("").alias("query"), key, newest, F.lit(0).alias("rank"))
    some = index.where(functools.reduce(lambda a, b: a | b, ranges)).select(key, newest, F.explode(hits).alias("h"))
    found = some.groupBy("h.query", "h.whole", key, newest).agg(F.bit_or("h.bit").alias("bits")).where("bits = whole")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col(newest).desc(), F.col(key).desc()))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", key, newest, "rank")
