"""Features of requirement and evidence texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reqlens import lexicon as L
from reqlens.functions import text as X

ANSWER_FIELDS = "label:string,confidence:double,matched_aspects:array<string>,missing_aspects:array<string>,conflict_aspects:array<string>,cited_phrases:array<string>,explanation:string"
ANSWER_ITEM = f"struct<index:int,{ANSWER_FIELDS}>"
CONSTRAINTS = "array<struct<kind:string,operator:string,value:double,unit:string>>"


def modality(c: Column) -> Column:
    """EXT-1: must_not, must, should, may or unknown, the first that is found."""
    return X.first_match(c, [(m, L.any_of(ws)) for m, ws in L.MODALITY], "unknown")


def requirement_type(c: Column, title: Column | None = None) -> Column:
    """EXT-2, EXT-3: rules on the section title, then rules on the text, else 'other'."""
    by_text = X.first_match(F.trim(X.text_of(c)), L.TEXT_TYPES, "other")
    if title is None:
        return by_text
    return F.coalesce(X.first_match(F.trim(X.text_of(title)), L.SECTION_TYPES), by_text)


def is_requirement_fragment(c: Column) -> Column:
    """EXT-12: a trigger word and five words."""
    return X.text_of(c).rlike(L.flags(L.any_of(L.REQUIREMENT_TRIGGERS))) & (X.word_count(c) >= 5)


def is_legacy_requirement(c: Column) -> Column:
    """EXT-42."""
    return X.text_of(c).rlike(L.flags(L.any_of(L.LEGACY_TRIGGERS)))


def _unit(raw: Column) -> Column:
    """EXT-7: the table is case-sensitive; other spellings are lower-cased."""
    table = F.create_map(*[F.lit(x) for kv in L.UNITS.items() for x in kv])
    return F.when(raw == "", F.lit(None).cast("string")).otherwise(F.coalesce(F.element_at(table, raw), F.lower(raw)))


def _kind(context: Column, unit: Column) -> Column:
    """EXT-6: keywords of the lower-cased context in order, then the unit's default."""
    lower = context
    out = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in L.KIND_OF_UNIT.items() for x in kv]), F.coalesce(unit, F.lit(""))), F.lit("generic"))
    for kind, needles in reversed(L.KINDS):
        hit = F.lit(False)
        for n in needles:
            hit = hit | lower.contains(n)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def constraints(c: Column) -> Column:
    """EXT-5: distinct (kind, operator, value, unit) of the numbers in a text.

    The operator is a sign before the number, else the longest operator phrase anywhere in the text, else '='. Numbers
    without a unit in the context of a reference (standard, clause, table) are left out (EXT-8). Offsets of the matches
    follow from the lengths of the gaps and matches before them.
    """
    text = X.text_of(c)
    pattern = L.flags(L.CONSTRAINT)
    whole, gaps = X.matches(text, pattern), F.split(text, pattern, -1)
    sign, number, raw = (X.matches(text, pattern, g) for g in (1, 2, 3))
    phrase = F.lit("=")
    for words, op in reversed(L.OPERATOR_PHRASES):
        phrase = F.when(F.lower(text).contains(words), F.lit(op)).otherwise(phrase)
    reference = "|".join(f"(?:{p})" for p in L.REFERENCES)

    def place(found: Column) -> Column:
        def one(i: Column) -> Column:
            before = F.aggregate(F.slice(found["gaps"], 1, i), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(found["whole"], 1, i - 1), F.lit(0), lambda a, m: a + F.length(m))
            match = F.element_at(found["whole"], i)
            return F.struct(match.alias("match"), F.element_at(found["number"], i).alias("value"), F.element_at(found["raw"], i).alias("raw"), F.element_at(found["sign"], i).alias("sign"), before.alias("at"))

        return F.when(F.size(found["whole"]) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(found["whole"]), F.lit(1))), one))

    def around(m: Column) -> Column:
        start = F.greatest(m["at"] - 60, F.lit(0))
        value_at = m["at"] + F.length(F.regexp_extract(m["match"], r"^\D*", 0))
        window = F.greatest(value_at - 30, F.lit(0))
        return F.struct(
            F.lower(F.substring(text, start + 1, m["at"] + F.length(m["match"]) + 20 - start)).alias("context"), F.substring(text, window + 1, value_at + F.length(m["value"]) + 5 - window).alias("window"),
            _unit(m["raw"]).alias("unit"), m["sign"].alias("sign"), m["value"].alias("value"),
        )

    def finish(m: Column) -> Column:
        return F.struct(
            _kind(m["context"], m["unit"]).alias("kind"), F.nullif(m["sign"], F.lit("")).alias("sign"), F.replace(m["value"], F.lit(","), F.lit(".")).cast("double").alias("value"), m["unit"].alias("unit"),
            (m["unit"].isNull() & m["window"].rlike(L.flags(reference))).alias("reference"),
        )

    matched = F.struct(whole.alias("whole"), gaps.alias("gaps"), sign.alias("sign"), number.alias("number"), raw.alias("raw"))
    found = F.transform(F.transform(X.let(matched, place), around), finish)
    kept = F.filter(found, lambda s: ~s["reference"])
    out = X.let(phrase, lambda op: F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), F.coalesce(s["sign"], op).alias("operator"), s["value"].alias("value"), s["unit"].alias("unit"))))
    return F.coalesce(F.array_distinct(F.when(text.rlike(r"\d"), out)), F.array().cast(CONSTRAINTS))


def entities(c: Column, stop=L.ENTITY_STOP, most: int = 15) -> Column:
    """EXT-9: title-case phrases, then acronyms; over two characters, not all of stop-words, first spelling of each, at most 15."""
    found = F.concat(X.matches(c, "(?U)" + L.ENTITY_PHRASE, 1), X.matches(c, "(?U)" + L.ENTITY_ACRONYM, 1))
    stops = X.strings(stop)
    named = F.filter(found, lambda t: (F.length(t) > 2) & ~F.array_contains(stops, F.lower(t)) & (F.size(F.array_except(F.split(F.lower(t), r"(?U)\s+"), stops)) > 0))
    return X.let(named, lambda n: X.let(F.transform(n, F.lower), lambda low: F.slice(F.filter(n, lambda t, i: F.array_position(low, F.lower(t)) == i + 1), 1, most)))


def is_boilerplate(c: Column) -> Column:
    """EXT-11: stamps, citations, headings glued to text, glossary lines and document codes."""
    text = F.trim(X.text_of(c))
    n = X.word_count(c)
    hit = lambda p: text.rlike(L.flags(p))
    unlisted = F.regexp_replace(text, "(?U)" + L.LIST_MARKER, "")
    signs = F.length(F.regexp_replace(X.text_of(c), r"[^\p{Nd}.\-/№]", ""))
    letters = F.length(F.regexp_replace(X.text_of(c), r"[^\p{L}]", ""))
    out = X.text_of(c) == ""
    for p in L.BOILERPLATE:
        out = out | hit(p)
    return (
        out
        | ((n <= 14) & hit(L.TRAILING_SECTION_NUMBER))
        | ((n <= 16) & hit(L.LEADING_PAGE_NUMBER))
        | ((n <= 16) & unlisted.rlike(L.flags(L.GOST_LINE)))
        | ((n <= 12) & hit(L.GOST_CITED))
        | ((n <= 18) & text.rlike("(?U)" + L.GLOSSARY))
        | ((n <= 8) & (letters > 0) & (signs > 0.4 * (letters + signs)))
        | ((n <= 50) & hit(L.GLUED_HEADINGS))
    )


def section_number(section_id: Column) -> Column:
    return F.regexp_extract(X.text_of(section_id), "(?U)" + L.SECTION_NUMBER, 1).try_cast("int")


def section_is_requirement(section_id: Column, title: Column) -> Column:
    """EXT-13 to EXT-15: by the leading number (4: yes; 1 to 3: no), else by the title (other kinds win), else null."""
    n = section_number(section_id)
    by_number = F.when(n.isin(*L.REQUIREMENT_SECTIONS), True).when(n.isin(*L.OTHER_SECTIONS), False)
    by_title = F.when(X.contains_any(title, L.OTHER_TITLES), False).when(X.contains_any(title, L.REQUIREMENT_TITLES), True)
    return F.coalesce(by_number, by_title)


def unit_type(kind: Column) -> Column:
    """EXT-18."""
    table = F.create_map(*[F.lit(x) for kv in L.UNIT_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(X.text_of(kind))), F.lit("paragraph"))


def is_list_intro(c: Column) -> Column:
    """EXT-19: a line that only introduces a list."""
    text = F.trim(X.text_of(c))
    return (text != "") & (text.rlike(r"(?U):\s*\.\s*$") | (text.endswith(":") & text.rlike(L.flags(L.LIST_INTRO))))


def is_heading_only(c: Column, title: Column) -> Column:
    """EXT-20: the text is the section's title."""
    bare = lambda x: F.lower(F.regexp_replace(F.trim(X.text_of(x)), r"(?U)[.\s]+$", ""))
    return (bare(c) != "") & (bare(c) == bare(title))


def is_self_contained(c: Column) -> Column:
    """EXT-21: a normative sentence with its own subject."""
    return X.text_of(c).rlike("(?U)" + L.SELF_CONTAINED)


def coverage_signals(c: Column) -> Column:
    """EXT-22."""
    return F.array_distinct(F.transform(X.matches(c, L.flags(L.COVERAGE_SIGNALS)), X.normalize))


def aspects(c: Column) -> Column:
    """EXT-23: alias groups, file extensions, and tokens that are technical, numeric, mixed-case or with digits."""
    groups = F.filter(F.array(*[F.when(X.contains_any(c, needles), F.lit(name)) for name, needles in L.ASPECTS.items()]), lambda x: x.isNotNull())
    ext = F.transform(X.matches(c, L.flags(L.FILE_EXTENSION)), F.lower)
    raw = X.matches(c, L.ASPECT_TOKEN)
    pairs = F.transform(raw, lambda r: F.struct(r.alias("raw"), F.regexp_replace(F.lower(r), r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "").alias("t")))
    kept = F.filter(
        pairs,
        lambda s: (s["t"] != "") & (F.array_contains(X.strings(L.TECH_KEYWORDS), s["t"]) | s["t"].rlike(r"^(\d+\.?\d*|\.\d+)$") | ((F.length(s["t"]) >= 3) & s["raw"].rlike(r"[A-Z\d]"))),
    )
    return F.array_distinct(F.concat(groups, ext, F.transform(ext, lambda e: F.ltrim(e, F.lit("."))), F.transform(kept, lambda s: s["t"])))


def subject_head(c: Column) -> Column:
    """EXT-26: key of the subject that a sentence of the text begins with, the first found."""
    heads = F.filter(F.transform(F.split(F.trim(X.text_of(c)), r"(?U)(?<=[.:;])\s+"), lambda s: F.lower(F.regexp_extract(F.trim(s), L.flags(L.SUBJECT_HEAD), 1))), lambda h: h != "")
    head = F.try_element_at(heads, F.lit(1))
    out = head
    for prefix, key in reversed(L.SUBJECT_KEYS):
        out = F.when(head.startswith(prefix), F.lit(key)).otherwise(out)
    return out


def action(c: Column) -> Column:
    """EXT-27: struct of the first action verb, the phrase after it up to one of :;,. and the phrase's content tokens."""
    text = X.text_of(c)
    pattern = L.flags(r"(?s)" + L.any_of(L.ACTION_VERBS) + r"\s*([^:;,.]*)")
    verb = F.lower(F.regexp_extract(text, pattern, 1))
    phrase = F.lower(F.trim(F.regexp_replace(F.regexp_extract(text, pattern, 2), r"(?U)\s+$", "")))
    return F.struct(F.nullif(verb, F.lit("")).alias("verb"), phrase.alias("phrase"), F.array_except(X.content_tokens(phrase), X.strings(L.OBJECT_STOP)).alias("tokens"))


def artifacts(c: Column) -> Column:
    """EXT-28: kinds of documents that a text names."""
    return F.filter(F.array(*[F.when(X.contains_any(c, forms), F.lit(name)) for name, forms in L.ARTIFACTS.items()]), lambda x: x.isNotNull())


def is_verification_step(c: Column) -> Column:
    """EXT-29."""
    return X.text_of(c).rlike(L.flags(L.VERIFICATION_STEP))


def has_normative_modal(c: Column) -> Column:
    """EXT-30."""
    return X.text_of(c).rlike(L.flags(L.NORMATIVE_MODAL))


def numbers(c: Column, pattern: str = L.NUMBER, group: int = 0) -> Column:
    """EXT-32, MSC-6: sorted distinct numbers with a decimal point."""
    return F.array_sort(F.array_distinct(F.transform(X.matches(c, L.flags(pattern), group), lambda n: F.replace(n, F.lit(","), F.lit(".")))))


def timeouts(c: Column) -> Column:
    return numbers(c, L.TIMEOUT, 1)


def attempts(c: Column) -> Column:
    return numbers(c, L.ATTEMPTS, 1)


def roles(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(X.matches(c, L.flags(L.any_of(L.ROLE_WORDS)), 1), F.lower)))


def json_object(c: Column, schema: str) -> Column:
    """EXT-37: the JSON object from the first to the last brace of a text."""
    return F.from_json(F.regexp_extract(X.text_of(c), r"(?s)\{.*\}", 0), schema)


def split_compound(c: Column, markers=L.LIST_MARKERS) -> Column:
    """EXT-17: "intro: items" as an array of "intro: item", by the first style of list marker that gives two valid items.

    The intro ends at the first colon outside brackets and has three words; the rest has four. An item has at most 40
    words, and two words or five characters. Other texts are returned whole.
    """
    text = F.trim(X.text_of(c))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("at"))

    def step(s: Column, ch: Column) -> Column:
        i = s["i"] + 1
        depth = F.when(ch.isin("(", "["), s["depth"] + 1).when(ch.isin(")", "]"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(i.alias("i"), depth.alias("depth"), F.when((s["at"] == 0) & (ch == ":") & (s["depth"] == 0), i).otherwise(s["at"]).alias("at"))

    colon = F.aggregate(F.split(text, ""), start, step, lambda s: s["at"])
    parts_of = lambda at: F.struct(F.trim(F.substring(text, F.lit(1), at - 1)).alias("intro"), F.regexp_replace(F.substring(text, at + 1, F.length(text)), r"(?U)^\s+|\s+$", "").alias("body"))

    def items(p: Column) -> Column:
        styles = []
        for m in markers:
            pieces = F.filter(F.transform(F.split(p["body"], m), lambda x: F.regexp_replace(x, r"^[ \t\n.,;:]+|[ \t\n.,;:]+$", "")), lambda x: x != "")
            valid = F.filter(pieces, lambda x: (X.word_count(x) <= 40) & ((X.word_count(x) >= 2) | (F.length(F.trim(x)) >= 5)))
            styles.append(X.let(valid, lambda v: F.when(F.size(v) >= 2, F.transform(v, lambda x: F.concat(p["intro"], F.lit(": "), x)))))
        return F.when((X.word_count(p["intro"]) >= 3) & (X.word_count(p["body"]) >= 4), F.coalesce(*styles))

    found = X.let(colon, lambda at: F.when((at > 0) & (at < F.length(text)), X.let(parts_of(at), items)))
    return F.coalesce(found, F.array(text))


def legacy_type(c: Column) -> Column:
    """EXT-4: the first of six types with a keyword in the text, else 'other'."""
    out = F.lit("other")
    for kind, needles in reversed(L.TYPE_KEYWORDS):
        out = F.when(X.contains_any(c, needles), F.lit(kind)).otherwise(out)
    return out


def marker_count(c: Column) -> Column:
    """EXT-33: words that a normative text states requirements by."""
    return F.regexp_count(X.text_of(c), F.lit(L.flags(L.REQUIREMENT_MARKER)))


def head_scores(c: Column) -> Column:
    """EXT-34: how often a document's head names a specification (tz) and a test programme (pmi); their titles count six times."""
    text = F.lower(X.text_of(c))

    def score(patterns) -> Column:
        return F.regexp_count(text, F.lit(L.flags("|".join(patterns)))) + F.when(text.rlike(L.flags(patterns[0])), L.TITLE_BONUS).otherwise(0)

    return F.struct(score(L.TZ_HEAD).alias("tz"), score(L.PMI_HEAD).alias("pmi"))


def head_type(scores: Column, least: int = 2) -> Column:
    """EXT-34: TZ or PMI by the higher score, from `least` on, else OTHER."""
    tz, pmi = scores["tz"], scores["pmi"]
    return F.when((tz > pmi) & (tz >= least), "TZ").when((pmi > tz) & (pmi >= least), "PMI").otherwise("OTHER")


def role_of_filename(c: Column) -> Column:
    """EXT-35: the role whose patterns a file name has, if it has those of one role only."""
    found = F.filter(F.array(*[F.when(F.lower(X.text_of(c)).rlike(L.flags("|".join(f"(?:{p})" for p in ps))), F.lit(r)) for r, ps in L.ROLE_FILENAMES.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def heading(c: Column) -> Column:
    """EXT-36: struct (section_id, title) of a line that is a heading, else null.

    A heading has a section number and up to 8 words, or is a title of up to 4 words (8 in capitals) that names a kind of
    section; a word that states a requirement makes it a sentence.
    """
    text = F.trim(F.regexp_replace(F.trim(X.text_of(c)), r"^\.+|\.+$", ""))
    number, title = (F.regexp_extract(text, "(?U)" + L.HEADING_NUMBER, g) for g in (1, 2))
    n = X.word_count(text)
    known = F.coalesce(F.when(X.contains_any(text, L.OTHER_TITLES), False), F.when(X.contains_any(text, L.REQUIREMENT_TITLES), True)).isNotNull()
    bare = (n <= L.BARE_HEADING_WORDS) | ((n <= L.HEADING_WORDS) & text.rlike("(?U)" + L.CAPS_TITLE))
    numbered = F.when((X.word_count(title) > 0) & (X.word_count(title) <= L.HEADING_WORDS), F.struct(number.alias("section_id"), F.trim(title).alias("title")))
    plain = F.when(bare & known, F.struct(F.lit("").alias("section_id"), text.alias("title")))
    return F.when((text != "") & ~text.rlike(L.flags(L.BODY_TRIGGER)), F.when(number != "", numbered).otherwise(plain))


def section_kind(section_id: Column, title: Column) -> Column:
    """MSC-18: req, non_req or unknown."""
    return X.let(section_is_requirement(section_id, title), lambda yes: F.when(yes, "req").when(~yes, "non_req").otherwise("unknown"))


def is_small_model(name: Column) -> Column:
    """EXT-41: models that get the compact prompt."""
    return X.contains_any(name, L.SMALL_MODELS)


def is_aspect_noise(c: Column) -> Column:
    """EXT-40: internal tags, and words that change script before a capital."""
    return F.lower(X.text_of(c)).isin(*L.ASPECT_NOISE) | X.text_of(c).rlike(L.MIXED_SCRIPT)
