"""Personal data: detection, merging, masking and restoring as DataFrame jobs.

Detection is a projection per row: no UDF, no shuffle. Offsets come from the lengths of matches and of the gaps between
them. Spans are arrays of (start, stop, pii_type, surface) with ends exclusive, counted in characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import identifiers as I
from tidewell.functions.text import let
from tidewell.operators.sampling import draw

SPAN = "array<struct<start:int,stop:int,pii_type:string,surface:string>>"
#: Types whose spans give way to any other span.
YIELDING = ("PSC",)


def matches(text: Column, pattern: str, pii_type: str) -> Column:
    """PII1: the spans of a pattern in a text; null for a null text. A text without any is read once."""
    gaps = F.split(text, pattern, -1)
    pairs = lambda found: F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        stop = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), stop.alias("stop"), F.lit(pii_type).alias("pii_type"), x["m"].alias("surface"))
        return F.struct(stop.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    offsets = lambda found: F.aggregate(pairs(found), start, step, lambda acc: acc["spans"])
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(offsets(found)))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def chosen_greedily(spans: Column, order, clash=overlap) -> Column:
    """Of an array of structs with start and stop, those that clash with none that comes before them in ``order``.

    ``order`` gives the columns to order an element by, the element itself last; ``clash`` holds between elements that
    overlap only. The array is sorted by start and cut into islands, where no element reaches beyond a cut: the choice in
    one does not depend on another, so the fold over an island looks back at the island's own choices alone.
    """

    def islands(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("k"), F.lit(-1).alias("end"), F.array().cast("array<int>").alias("cuts"))
        step = lambda acc, s: F.struct(
            (acc["k"] + 1).alias("k"), F.greatest(acc["end"], s["stop"]).alias("end"), F.when(s["start"] >= acc["end"], F.array_append(acc["cuts"], acc["k"])).otherwise(acc["cuts"]).alias("cuts")
        )
        cuts = F.aggregate(a, start, step, lambda acc: acc["cuts"])
        return let(cuts, lambda c: F.transform(c, lambda at, i: F.slice(a, at + 1, F.coalesce(F.get(c, i + 1), F.size(a)) - at)))

    def choose(island: Column) -> Column:
        keys = F.sort_array(F.transform(island, lambda s: F.struct(*order(s), s.alias("span"))))
        step = lambda kept, k: F.when(F.exists(kept, lambda x: clash(x, k["span"])), kept).otherwise(F.array_append(kept, k["span"]))
        return F.when(F.size(island) == 1, island).otherwise(F.aggregate(keys, F.slice(island, 1, 0), step))

    return let(F.sort_array(spans), lambda a: F.when(F.size(a) < 2, a).otherwise(F.flatten(F.transform(islands(a), choose))))


def without_overlap(spans: Column, *order: str) -> Column:
    """Greedy choice in the given order; the result is ordered by start."""
    return F.sort_array(chosen_greedily(spans, lambda s: [_key(s, o) for o in order]))


def _key(s: Column, name: str) -> Column:
    return {"longest": s["start"] - s["stop"], "earliest": s["start"], "type": s["pii_type"]}[name].alias(name)


RULES = ("EMAIL", "PHONE", "DIC", "PSC", "ICO", "RC", "IBAN_CZ", "BBAN")
CHECKS = {"ICO": I.ico_ok, "RC": I.birth_number_ok, "IBAN_CZ": I.iban_ok}


def rule_spans(text: Column, types: tuple[str, ...] = RULES) -> Column:
    """PII5: all shapes, checksums where there are any; of overlapping spans the longest stays, then the earliest.

    A shape is only looked for in texts with a character that it cannot do without; most texts have none.
    """
    parts = {}
    for t in types:
        found = matches(text, I.SHAPES[t], t)
        parts.setdefault(I.NEEDED.get(t, "[0-9]"), []).append(F.filter(found, _checked(t)) if t in CHECKS else found)
    none = F.array().cast(SPAN)
    gated = [F.when(text.rlike(needed), F.concat(*some)).otherwise(none) for needed, some in parts.items()]
    return F.when(text.isNotNull(), without_overlap(F.concat(*gated), "longest", "earliest", "type"))


def _checked(pii_type: str):
    return lambda s: CHECKS[pii_type](s["surface"])


def located(text: Column, values: tuple[str, ...]) -> Column:
    """PII15: the spans of planted values, the longest first, none overlapping."""
    found = [matches(text, r"\Q" + v.replace(r"\E", r"\E\\E\Q") + r"\E", "PLANTED") for v in values]
    return without_overlap(F.concat(*found), "longest", "earliest", "type")


def snapped(text: Column, start: Column, stop: Column, letter: str = "[A-Za-zÀ-ÿ]", trail: str = "[ ,;:!?)]+") -> tuple[Column, Column]:
    """PII8: offsets without trailing marks (a dot stays, as of an abbreviation), then out to whole words on both sides."""
    end = stop - F.length(F.regexp_extract(text.substr(start + 1, stop - start), f"{trail}$", 0))
    first, last = text.substr(start + 1, F.lit(1)), text.substr(end, F.lit(1))
    before = F.regexp_extract(text.substr(F.lit(1), start), f"{letter}*$", 0)
    after = F.regexp_extract(text.substr(end + 1, F.length(text)), f"^{letter}*", 0)
    begin = start - F.when(first.rlike(f"^{letter}$"), F.length(before)).otherwise(0)
    return begin, end + F.when((end > 0) & last.rlike(f"^{letter}$"), F.length(after)).otherwise(0)


def exploded(df: DataFrame, key: str, spans: str = "spans") -> DataFrame:
    """A row per span. The outer form, as for the plain one the optimizer adds a filter that detects all spans once more."""
    return df.select(key, F.explode_outer(spans).alias("s")).where("s IS NOT NULL").select(key, "s.*")


def join_fragments(spans: DataFrame, texts: DataFrame, key: str, gap: str = r"^[\s,]*$") -> DataFrame:
    """PII6: neighbouring spans of one type with nothing but the gap pattern between them become one (gaps and islands)."""
    item = F.struct("start", "stop", "pii_type", "confidence")
    # a text travels once, to the list of its spans, and never with each of them
    joined = spans.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("all")).join(texts.select(key, "text"), key)

    def goes_on(s: Column, i: Column) -> Column:
        last = F.get("all", i - 1)
        return F.when(last["pii_type"] == s["pii_type"], F.col("text").substr(last["stop"] + 1, s["start"] - last["stop"]).rlike(gap))

    marked = F.transform("all", lambda s, i: F.struct(i.alias("place"), s.alias("span"), F.when(goes_on(s, i), 0).otherwise(1).alias("new")))
    rows = exploded(joined.select(key, marked.alias("spans")), key).select(key, "place", "span.*", "new")
    islands = rows.withColumn("island", F.sum("new").over(Window.partitionBy(key).orderBy("place")))
    return islands.groupBy(key, "island", "pii_type").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("confidence").alias("confidence")).drop("island")


def merge_by_precedence(spans: DataFrame, key: str) -> DataFrame:
    """PII7: hard rules first, then model spans by confidence, yielding rule spans last; no two overlap.

    ``spans`` has key, start, stop, pii_type, source ('rule' or 'model') and confidence.
    """
    tier = F.when((F.col("source") == "rule") & ~F.col("pii_type").isin(*YIELDING), 0).when(F.col("source") == "model", 1).otherwise(2)
    item = F.struct("start", "stop", "pii_type", "source", tier.alias("tier"), (-F.coalesce("confidence", F.lit(0.0))).alias("doubt"))
    lists = spans.groupBy(key).agg(F.collect_list(item).alias("all"))
    chosen = chosen_greedily(F.col("all"), lambda s: [s["tier"].alias("t"), s["doubt"].alias("d"), s["start"].alias("a"), s["stop"].alias("b")])
    return lists.select(key, F.explode(chosen).alias("s")).select(key, "s.start", "s.stop", "s.pii_type", "s.source")


def form_suffix(index: Column) -> Column:
    """'' for the first form, then b to z, then two letters."""
    letter = lambda n: F.chr(n + 97)
    return F.when(index == 0, "").when(index < 26, letter(index)).otherwise(F.concat(letter(F.floor(index / 26) - 1), letter(index % 26)))


def shuffled_number(place: Column, *seed: Column | str) -> Column:
    """The number from 1 to 9999 at a place from 0 to 9998, in an order of its own for each seed.

    A place has two digits, to the bases 99 and 101. Four rounds in turn add a keyed hash of one digit to the other; each
    round can be undone, so no number comes twice, without any state.
    """

    def rounds(at: Column, k: int) -> Column:
        high, low = at["high"], at["low"]
        if k == 4:
            return high * 101 + low + 1
        if k % 2:
            low = (low + draw(*seed, str(k), high.cast("string"))) % 101
        else:
            high = (high + draw(*seed, str(k), low.cast("string"))) % 99
        return let(F.struct(high.alias("high"), low.alias("low")), lambda x: rounds(x, k + 1))

    low = place.cast("long") % 101
    return let(F.struct(((place.cast("long") - low) / 101).cast("long").alias("high"), low.alias("low")), lambda x: rounds(x, 0))


def tokens_for(spans: DataFrame, texts: DataFrame, key: str, unify: str = "entity", numbering: str = "reading", secret: str = "") -> DataFrame:
    """PII10: the token of each span, with a suffix by surface form where forms share a number.

    ``unify`` says which spans of a text share a number: 'none', those of one type and surface ('exact') or those of one
    'entity'. ``numbering`` counts each type by first occurrence ('reading'), or takes numbers from 1 to 9999 in an order
    that ``secret`` and key shuffle, each once in a text whatever the type ('random'); a text with more is an error.
    Numbers that a text already uses in a tag (in reading order, of that type) are skipped.
    """
    if numbering not in ("reading", "random"):
        raise ValueError(f"numbering is reading or random, not {numbering!r}")
    one = {"none": F.col("start").cast("string"), "exact": F.col("surface"), "entity": I.entity_key(F.col("pii_type"), F.col("surface"))}
    if unify not in one:
        raise ValueError(f"unify is one of {', '.join(one)}, not {unify!r}")
    # a text's spans come together once, as a list; windows within the text number them, so they are computed once
    row = F.struct("start", "stop", "pii_type", "surface", one[unify].alias("entity"))
    lists = spans.groupBy(key).agg(F.collect_list(row).alias("_spans"))
    keyed = lists.select(key, F.explode("_spans").alias("s")).select(key, "s.*")
    of = lambda *more: Window.partitionBy(key, *more)
    placed = keyed.withColumn("_at", F.min("start").over(of("pii_type", "entity"))).withColumn("_form_at", F.min("start").over(of("pii_type", "entity", "surface")))
    line = of().orderBy("_at", "pii_type", "entity") if numbering == "random" else of("pii_type").orderBy("_at", "entity")
    numbered = placed.withColumn("_number", F.dense_rank().over(line)).withColumn("_form", F.dense_rank().over(of("pii_type", "entity").orderBy("_form_at", "surface")) - 1)
    tags = texts.select(key, F.regexp_extract_all("text", F.lit(r"<([A-Z_]+_[0-9]+)[a-z]*>"), 1).alias("_tags"))
    used = lambda t: F.regexp_extract(t, "([0-9]+)$", 1).try_cast("long")
    if numbering == "random":
        places = F.sequence(F.lit(0), F.least(F.col("_n") + F.size("_tags"), F.lit(9999)).cast("int") - 1)
        order = F.transform(places, lambda j: shuffled_number(j, secret, F.col(key).cast("string")))
        entities = F.size(F.array_distinct(F.transform("_spans", lambda s: F.struct(s["pii_type"], s["entity"]))))
        tags = lists.select(key, entities.alias("_n")).join(tags, key).select(key, F.array_except(order, F.transform("_tags", used)).alias("_free"))
        free = F.col("_free")
    else:
        own = F.transform(F.filter("_tags", lambda t: F.regexp_replace(t, "_[0-9]+$", "") == F.col("pii_type")), used)
        free = F.array_except(F.sequence(F.lit(1).cast("long"), F.col("_number") + F.size(own).cast("long")), own)
    joined = numbered.join(tags, key)
    number = F.when(F.col("_number") <= F.size(free), F.element_at(free, F.col("_number"))).otherwise(F.raise_error(F.lit("a text has no free token number left")).cast("long"))
    token = F.concat(F.lit("<"), "pii_type", F.lit("_"), number.cast("string"), form_suffix(F.col("_form")), F.lit(">"))
    return joined.select(key, "start", "stop", "pii_type", "surface", "entity", token.alias("token"))


def session_vault(mentions: DataFrame, session: str, at: str) -> DataFrame:
    """PII14: rows (session, pii_type, entity, surface, token, uses) of mentions (session, pii_type, entity, surface, at).

    Entities are numbered by their first use in a session, type by type; further surface forms get a suffix each.
    """
    forms = mentions.groupBy(session, "pii_type", "entity", "surface").agg(F.min(at).alias("_at"), F.count("*").alias("uses"))
    of = Window.partitionBy(session, "pii_type", "entity")
    placed = forms.withColumn("_first", F.min("_at").over(of)).withColumn("_form", F.row_number().over(of.orderBy("_at", "surface")) - 1)
    number = F.dense_rank().over(Window.partitionBy(session, "pii_type").orderBy("_first", "entity"))
    token = F.concat(F.lit("<"), "pii_type", F.lit("_"), number.cast("string"), form_suffix(F.col("_form")), F.lit(">"))
    return placed.select(session, "pii_type", "entity", "surface", token.alias("token"), "uses")


def resolved(requests: DataFrame, vault: DataFrame, session: str) -> DataFrame:
    """PII14: requests (session, token) with the surface behind the token and a status.

    'ok'; 'malformed' for what is no token; 'unknown' for a token that this session never gave out, whoever else did.
    """
    known = vault.select(session, "token", "surface")
    status = F.when(~F.coalesce("token", F.lit("")).rlike("^<[A-Z_]+_[0-9]+[a-z]*>$"), "malformed").when(F.col("surface").isNull(), "unknown").otherwise("ok")
    return requests.join(known, [session, "token"], "left").select(session, "token", "surface", status.alias("status"))


def masked(texts: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Texts with their spans replaced by tokens, and the map back; a text without spans stays."""
    lists = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "token", "surface"))).alias("found"))
    joined = texts.join(lists, key, "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    build = F.aggregate(
        "found",
        begin,
        lambda a, s: F.struct(s["stop"].alias("at"), F.concat(a["out"], F.col("text").substr(a["at"] + 1, s["start"] - a["at"]), s["token"]).alias("out")),
        lambda a: F.concat(a["out"], F.col("text").substr(a["at"] + 1, F.length("text"))),
    )
    back = F.map_from_entries(F.array_distinct(F.transform("found", lambda s: F.struct(s["token"], s["surface"]))))
    return joined.select(key, F.col("text"), F.when(F.col("found").isNull(), F.col("text")).otherwise(build).alias("masked"), back.alias("back"))


def restored(masked_text: Column, back: Column) -> Column:
    """PII11: tokens back to their values, longest token first."""
    order = F.sort_array(F.transform(F.map_keys(back), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("token"))))
    return F.when(back.isNull(), masked_text).otherwise(F.aggregate(order, masked_text, lambda text, t: F.replace(text, t["token"], F.element_at(back, t["token"]))))


def tag_spans(tagged: DataFrame, key: str) -> DataFrame:
    """PII17: rows (key, pos, start, stop, tag) with B- and I- tags to spans; an I- goes on only after its own label."""
    w = Window.partitionBy(key).orderBy("pos")
    label = F.regexp_replace("tag", "^[BI]-", "")
    on = F.col("tag").startswith("I-") & (F.lag("label").over(w) == F.col("label"))
    marked = tagged.withColumn("label", F.when(F.col("tag") == "O", None).otherwise(label))
    islands = marked.withColumn("new", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(w)).where("label IS NOT NULL")
    return islands.groupBy(key, "island", "label").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def column_policy(df: DataFrame, policy: dict[str, str], salt: str) -> DataFrame:
    """PII13: each column by its policy: 'open' stays, 'token' becomes a stable typed token, 'drop' goes, 'text' has its
    rule spans blanked by type; columns without a policy go."""
    out = []
    for c, how in policy.items():
        if how == "open":
            out.append(F.col(c))
        elif how == "token":
            out.append(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{c.upper()}_"), F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col(c).cast("string"))), 1, 10), F.lit(">"))).alias(c))
        elif how == "text":
            text = F.col(c)
            for t in ("EMAIL", "PHONE", "BBAN"):
                text = F.regexp_replace(text, I.SHAPES[t], f"<{t}>")
            out.append(text.alias(c))
    return df.select(*out)
