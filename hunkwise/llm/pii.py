"""PII (4): information-theoretic sanitisation, on DataFrame functions alone.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. Words that go with an entity may give it away even
when it is gone. The corpus says how strongly: a word t reveals an entity e by PMI(t, e) = log2 p(e | t) / p(e) of the -log2 p(e) bits
that e itself has. Words that reveal the share GENERALISE of it or more are generalised, and removed from the share REMOVE, wherever
they stand.

Values seldom recur, so an entity backs off: to its value if that stands in SUPPORT different places, else to its class (mail domain, two
parts of an IP address, six digits of a card, four of a phone number) if what is left of that does, else to its kind. A place is the
value with the SURROUNDINGS code points on either side; copies and near copies of a passage share their places. An entity counts its
places, a word its different texts, both together the places in texts with the word, where a place that m texts share is 1/m in each, and a text has one at most:

    p(e) = places(e) / texts,   p(e | t) = places(t, e) / (texts(t) + 1),

and places(t, e) must be SUPPORT at least and PMI LEAST_BITS, so that neither chance nor a common kind makes a word tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.llm import common

KINDS = ("email", "ip", "card", "phone")
# The patterns cannot backtrack into a run of characters nor start inside one, so that long runs take linear time; a match may
# start where the last one ended (\G), as leftmost non-overlapping matches do.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Code points on either side of an entity that make its place.
SURROUNDINGS = 16
SUPPORT, LEAST_BITS, GENERALISE, REMOVE = 3, 3.0, 0.8, 0.95
#: Keys of words, texts or rows, up to this number, are sent to all executors; more are joined by shuffle.
BROADCAST_TERMS = 200_000
_GAPS = r"[\x00-/:-@\[-`{-\x7f]+"
_WORD = r"[^\x00-/:-@\[-`{-\x7f]+"
_INNER = r"[0-9A-Za-z\x{80}-\x{10ffff}]"
_BLOCK = 64


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def located(df: DataFrame, text: str, pattern: str | Column, name: str, when: Column) -> DataFrame:
    """df with column `name`: array of (start, end, value), code points, of all leftmost non-overlapping matches.

    What lies between the matches, from the same pattern, gives their places: sums of lengths, by blocks of 64.
    """
    m, gaps, lengths, blocks = (f"__{name}_{x}" for x in ("m", "g", "l", "b"))
    empty = F.array().cast("array<string>")
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    df = df.withColumn(m, F.when(when, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(empty))
    df = df.withColumn(gaps, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(empty))
    df = df.withColumn(lengths, F.transform(m, lambda x, i: F.length(F.get(gaps, i)) + F.length(x)))
    plus = lambda a, b: a + b
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(m) - 1) / _BLOCK))), lambda b: F.aggregate(F.slice(lengths, b.cast("int") * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), plus))
    df = df.withColumn(blocks, F.when(F.size(m) > 0, starts))
    whole = lambda i: F.aggregate(F.slice(blocks, F.lit(1), F.floor(i / _BLOCK).cast("int")), F.lit(0), plus)
    rest = lambda i: F.aggregate(F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1), F.lit(0), plus)
    ends = F.transform(m, lambda x, i: F.struct(x.alias("value"), (whole(i) + rest(i)).alias("end")))
    spans = F.transform(ends, lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return df.withColumn(name, F.when(F.size(m) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))).drop(m, gaps, lengths, blocks)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base: array of (start, rank, end, kind, value), by start, then kind as in KINDS."""
    t = F.col(text)
    may = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][ -]?[0-9]"), "phone": t.contains("+")}
    for kind in KINDS:
        docs = located(docs, text, PATTERNS[kind], f"__{kind}", may[kind])
    own = []
    for rank, kind in enumerate(KINDS):
        good = F.filter(f"__{kind}", lambda s: is_valid(kind, s["value"]))  # noqa: B023
        own.append(F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))))  # noqa: B023
    return docs.withColumn("base", F.array_sort(F.concat(*own))).drop(*[f"__{k}" for k in KINDS])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _levels(s: Column) -> list[Column]:
    """An entity's value, class and kind, as hashes."""
    digits = F.regexp_replace(s["value"], "[^0-9]", "")
    low = F.lower(s["value"])
    value = F.when(s["kind"].isin("card", "phone"), digits).otherwise(low)
    of = F.when(s["kind"] == "email", F.substring_index(low, "@", -1)).when(s["kind"] == "ip", F.substring_index(low, ".", 2))
    of = of.when(s["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    return [F.xxhash64(s["kind"], F.lit("value"), value), F.xxhash64(s["kind"], F.lit("class"), of), F.xxhash64(s["kind"])]


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has no more than BROADCAST_TERMS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(text, _GAPS), lambda w: F.lower(w)))


def _outside(text: str) -> Column:
    """What of a text is outside of its base spans, in one."""
    ends = F.transform("base", lambda s: s["end"])
    before = lambda i: F.when(i > 0, F.array_max(F.slice(ends, F.lit(1), i))).otherwise(0)
    parts = F.transform("base", lambda s, i: F.substring(text, before(i) + 1, F.greatest(F.lit(0), s["start"] - before(i))))
    return F.array_join(F.concat(parts, F.array(F.substring(text, F.array_max(ends) + 1, F.length(text)))), " ")


def entity_places(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of d (copy, around): (copy, entities array of (entity, places)) of texts with entities, and (entity, entity_places)."""
    seen = common.stored(d.filter("around is not null").select("copy", F.explode("around").alias("a")).select("copy", "a.*").distinct(), "pii-places")
    places = common.stored(seen.groupBy("place").agg(F.count("*").alias("texts"), *[F.min(c).alias(c) for c in ("value", "class", "kind")]), "pii-shared")
    often = lambda df, c: _small(common.stored(df.groupBy(c).agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT).select(c), f"pii-{c}")).withColumn(f"by_{c}", F.lit(True))
    places = places.join(often(places, "value"), "value", "left")
    places = places.join(often(places.filter("by_value is null"), "class"), "class", "left")
    entity = F.when(F.col("by_value"), F.col("value")).when(F.col("by_class"), F.col("class")).otherwise(F.col("kind"))
    places = common.stored(places.select("place", entity.alias("entity"), "texts"), "pii-backed")
    of_entity = places.groupBy("entity").agg(F.count("*").alias("entity_places")).filter(F.col("entity_places") >= SUPPORT)
    held = seen.select("copy", "place").join(places, "place").groupBy("copy", "entity").agg(F.least(F.lit(1.0), F.sum(1 / F.col("texts"))).alias("places"))
    return held.groupBy("copy").agg(F.collect_list(F.struct("entity", "places")).alias("entities")), common.stored(of_entity, "pii-entities")


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, __row, base and terms, both arrays of (start, rank, end, kind, value).

    terms are the disclosing words, wherever they stand outside of entities; their kind is term, and value what becomes of them
    (generalise or remove). A null text is empty. Equal rows get equal results; other columns are left out; an empty table gives
    an empty result.
    """
    key = F.xxhash64("doc_id", "text")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__row", key)
    texts = d.select("__row", F.xxhash64("text").alias("copy"), "text")
    start = lambda s: F.greatest(F.lit(0), s["start"] - SURROUNDINGS)

    def place(s: Column) -> Column:
        value, of, kind = _levels(s)
        around = F.substring("text", start(s) + 1, s["end"] - start(s) + SURROUNDINGS)
        return F.struct(value.alias("value"), of.alias("class"), kind.alias("kind"), F.xxhash64(value, around).alias("place"))

    d = base_spans(d).withColumn("around", F.when(F.size("base") > 0, F.array_distinct(F.transform("base", place))))
    outside = F.when(F.size("base") > 0, _outside("text"))  # of few texts, so that the others need not be looked at again
    d = common.stored(d.select("doc_id", "__row", F.xxhash64("text").alias("copy"), "base", "around", outside.alias("outside")), "pii-base")

    # Each of c rows of one text counts 1/c, so that sums count different texts without a shuffle of their words.
    copies = common.stored(d.groupBy("copy").agg(F.count("*").alias("c")), "pii-copies")
    n = float(copies.count())
    again = _small(copies.filter("c > 1"))
    of_term = texts.join(again, "copy", "left").select((1 / F.coalesce("c", F.lit(1))).alias("weight"), F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.round(F.sum("weight")).alias("term_texts"))
    entities, of_entity = entity_places(d)
    rows = d.filter("outside is not null").select("copy", "outside").join(entities, "copy").join(again, "copy", "left")
    rows = rows.select((1 / F.coalesce("c", F.lit(1))).alias("weight"), "entities", F.explode(_words(F.col("outside"))).alias("term")).select("weight", "term", F.explode("entities").alias("e"))
    joint = rows.groupBy("term", "e.entity").agg(F.sum(F.col("weight") * F.col("e.places")).alias("joint")).filter((F.col("joint") >= SUPPORT - 1e-6) & (F.col("term") != ""))
    joint = common.stored(joint.join(_small(of_entity), "entity"), "pii-joint")
    of_term = of_term.join(_small(joint.select("term").distinct()), "term", "left_semi")
    bits, whole = F.log2(F.col("joint") / (F.col("term_texts") + 1) * n / F.col("entity_places")), F.log2(n / F.col("entity_places"))
    told = joint.join(_small(common.stored(of_term, "pii-words")), "term").filter((bits >= LEAST_BITS) & (bits >= GENERALISE * whole - 1e-9))
    told = common.stored(told.groupBy("term").agg(F.max(bits / whole).alias("share")), "pii-terms")

    # Of the words of all texts, the forms of disclosing ones; they make a pattern of their own for each text that has any.
    forms = texts.select("__row", F.explode(F.array_distinct(F.split("text", _GAPS))).alias("form")).withColumn("term", F.lower("form")).join(_small(told), "term")
    action = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")
    hits = common.stored(forms.groupBy("__row").agg(F.collect_set(F.struct("form", action.alias("action"))).alias("forms")), "pii-hits")
    pattern = F.concat(F.lit(f"(?<!{_INNER})(?:"), F.array_join(F.transform("forms", lambda f: f["form"]), "|"), F.lit(f")(?!{_INNER})"))
    flagged = common.stored(texts.join(_small(hits), "__row").withColumn("pattern", pattern), "pii-flagged")
    flagged = located(flagged, "text", F.col("pattern"), "words", F.lit(True)).withColumn("known", F.map_from_entries("forms"))
    terms = F.transform("words", lambda w: F.struct(w["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), w["end"].alias("end"), F.lit("term").alias("kind"), F.element_at("known", w["value"]).alias("value")))
    flagged = flagged.select("__row", terms.alias("terms")).dropDuplicates(["__row"])
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    outside = F.filter("terms", lambda w: ~F.exists("base", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])))
    return d.join(flagged, "__row", "left").select("doc_id", "__row", "base", F.coalesce(outside, none).alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with its text sanitised and spans, what was found in the old text: array of (start, rank, end, kind, value).

    An entity becomes its kind in brackets, a generalised word [WORD]; a removed word goes. Of overlapping spans the first, then the
    longest, is replaced. A column named spans is replaced, others pass; a null text stays null.
    """
    rows = common.drop_clashes(docs, ["spans", "__row", "__spans"]).withColumn("__row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = find(docs).select("__row", F.array_sort(F.concat("base", "terms")).alias("__spans")).dropDuplicates(["__row"])
    out = rows.join(found, "__row", "left")
    first = F.aggregate(F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"], (-s["end"]).alias("e"), s["kind"].alias("kind"), s["value"].alias("value")))), F.array().cast("array<struct<start:int,e:int,kind:string,value:string>>"), lambda kept, s: F.when((F.size(kept) == 0) | (s["start"] >= -F.element_at(kept, -1)["e"]), F.concat(kept, F.array(s))).otherwise(kept))
    out = out.withColumn("__kept", F.when(F.size("__spans") > 0, first))
    new = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "remove", "").otherwise("[WORD]")
    parts = F.transform("__kept", lambda s, i: F.concat(F.substring("text", F.when(i > 0, -F.get("__kept", i - 1)["e"]).otherwise(0) + 1, s["start"] - F.when(i > 0, -F.get("__kept", i - 1)["e"]).otherwise(0)), new(s)))
    clean = F.concat(F.array_join(parts, ""), F.substring("text", 1 - F.element_at("__kept", -1)["e"], F.length("text")))
    return out.withColumn("text", F.when(F.col("__kept").isNull(), F.col("text")).otherwise(clean)).withColumn("spans", F.col("__spans")).drop("__row", "__spans", "__kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(common.table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def brute_base(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by the patterns as they are given, for tests."""
    import re

    def luhn(digits: str) -> bool:
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    out = [(m.start(), rank, kind, m.end()) for rank, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def brute_terms(texts: list[str | None]) -> dict[str, float]:
    """The disclosing words of different texts and the share that each reveals, by plain counting, for tests."""
    import math
    import re
    from collections import defaultdict

    whole = sorted({t or "" for t in texts})
    words = lambda t: {w.lower() for w in re.split(_GAPS, t) if w}
    places, with_term = defaultdict(set), defaultdict(int)  # (kind, value, class, surroundings): texts
    for i, t in enumerate(whole):
        for w in words(t):
            with_term[w] += 1
        for kind, a, b in brute_base(t):
            value, digits = t[a:b].lower(), re.sub("[^0-9]", "", t[a:b])
            of = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
            places[kind, digits if kind in ("card", "phone") else value, of, t[max(0, a - SURROUNDINGS) : b + SURROUNDINGS]].add(i)
    by_value, by_class, entities = defaultdict(int), defaultdict(int), defaultdict(list)
    for kind, value, _, _ in places:
        by_value[kind, value] += 1
    for kind, value, of, _ in places:
        by_class[kind, of] += by_value[kind, value] < SUPPORT
    for (kind, value, of, _), own in places.items():
        entities[("value", kind, value) if by_value[kind, value] >= SUPPORT else ("class", kind, of) if by_class[kind, of] >= SUPPORT else (kind,)].append(own)
    outside = {}
    for i in set().union(*[x for own in entities.values() for x in own]):
        inside = {at for _, a, b in brute_base(whole[i]) for at in range(a, b)}
        outside[i] = words("".join(" " if at in inside else c for at, c in enumerate(whole[i])))
    told: dict[str, float] = {}
    for own in entities.values():
        joint, held = defaultdict(float), defaultdict(float)
        for texts_of in own:
            for i in texts_of:
                held[i] += 1 / len(texts_of)
        for i, n in held.items():
            for w in outside[i]:
                joint[w] += min(1.0, n)
        own_bits = math.log2(len(whole) / len(own))
        for w, j in joint.items():
            bits = math.log2(j / (with_term[w] + 1) * len(whole) / len(own))
            if len(own) >= SUPPORT and j >= SUPPORT - 1e-6 and bits >= LEAST_BITS and bits >= GENERALISE * own_bits - 1e-9:
                told[w] = max(told.get(w, 0.0), bits / own_bits)
    return told


def brute_spans(text: str | None, told: dict[str, float]) -> list[tuple[int, int, str]]:
    """The spans of disclosing words of a text outside of base spans, for tests."""
    import re

    base = brute_base(text)
    found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(_WORD, text or "")]
    return [(a, b, "remove" if told[w] >= REMOVE else "generalise") for a, b, w in found if w in told and not any(x < b and y > a for _, x, y in base)]
