"""Text normalisation and tokens, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reqlens import lexicon as L

STRINGS = "array<string>"


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(STRINGS)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression named inside a lambda is otherwise computed at each call."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize(c: Column) -> Column:
    """TXT-1: lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " ")), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit(pattern), F.lit(group))


def tokens(c: Column, pattern: str = L.TOKEN) -> Column:
    """TXT-3 / TXT-6: distinct lower-cased tokens."""
    return F.array_distinct(F.transform(matches(c, pattern), F.lower))


def content_tokens(c: Column, stop_words=L.STOP_WORDS, lemmas: dict[str, str] | None = None) -> Column:
    """TXT-2: distinct tokens without stop-words, by surface and by lemma (TXT-5; without a dictionary the token itself)."""
    found = F.array_except(tokens(c), strings(stop_words))
    if not lemmas:
        return found
    table = F.create_map(*[F.lit(x) for kv in lemmas.items() for x in kv])
    return F.array_except(F.array_distinct(F.transform(found, lambda t: F.coalesce(F.element_at(table, t), t))), strings(stop_words))


def term_counts(c: Column, pattern: str = L.TOKEN) -> Column:
    """TXT-4: array of (token, count)."""
    sorted_ = F.array_sort(F.transform(matches(c, pattern), F.lower))

    def counted(all_: Column) -> Column:
        # in sorted order a token's count is the distance of its first place from the next token's
        n = F.size(all_)
        firsts = F.filter(F.transform(all_, lambda t, i: F.struct(t.alias("token"), i.alias("i"))), lambda s: (s["i"] == 0) | (F.get(all_, s["i"] - 1) != s["token"]))
        return let(firsts, lambda f: F.transform(f, lambda s, k: F.struct(s["token"].alias("token"), (F.coalesce(F.get(f, k + 1)["i"], n) - s["i"]).alias("n"))))

    return let(sorted_, counted)


def strip_punctuation(c: Column) -> Column:
    """TXT-7."""
    return F.trim(F.regexp_replace(F.regexp_replace(text_of(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def sentences(c: Column, abbreviations=L.ABBREVIATIONS) -> Column:
    """TXT-8: sentences end at [.!?…] before white space and an upper-case letter, digit or '-'; known abbreviations don't end one.

    Abbreviations match inside words and regardless of case, and come out in lower case.
    """
    out = text_of(c)
    for a in abbreviations:
        out = F.regexp_replace(out, "(?iu)" + a.replace(".", r"\."), a.replace(".", "\x01"))
    parts = F.split(out, r"(?U)(?<=[.!?…])\s+(?=[\p{Lu}\p{Nd}-])")
    return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("\x01"), F.lit(".")))), lambda p: p != "")


def cut_at_sentence(c: Column, limit: int) -> Column:
    """TXT-9: at most `limit` characters, up to the last of .!?» in them, else the last space."""
    head = F.substring(c, 1, limit)
    boundary = F.regexp_extract(head, r"(?s)^(.+[.!?»]|.*?(?!^)[.!?»])", 1)
    space = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    whole = F.when(F.length(boundary) > 1, boundary).when(head.contains(" "), space).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.trim(whole))


def label_key(c: Column) -> Column:
    """TXT-10: normalised, without punctuation at the end."""
    return F.regexp_replace(normalize(c), r"(?U)[\s.,;:!?]+$", "")


def ellipsis(c: Column, limit: int) -> Column:
    """TXT-12."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


def contains_any(c: Column, needles) -> Column:
    """Any of the needles (lower-cased) in the lower-cased text."""
    lower = F.lower(text_of(c))
    out = F.lit(False)
    for n in needles:
        out = out | lower.contains(n.lower())
    return out


def first_match(c: Column, rules, otherwise: str | None = None) -> Column:
    """Ordered rules (value, pattern): the value of the first pattern that is found."""
    out = F.lit(otherwise)
    for value, pattern in reversed(list(rules)):
        out = F.when(text_of(c).rlike(L.flags(pattern)), F.lit(value)).otherwise(out)
    return out
