"""Text functions as column expressions: no user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.rules import SOUND_FOLDS

_LETTER = r"[\p{L}\p{Nl}\p{No}]"
TOKEN = f"{_LETTER}+(?:['’]{_LETTER}+)*"
_BLANK = r"[ \t\n\x0B\f\r]+"


def lookup_key(c: Column) -> Column:
    """Lexicon key: straight apostrophes, no underscores, folded case, single blanks."""
    plain = F.translate(c, "’‘ʼ_", "''' ")
    folded = F.replace(F.lower(plain), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, _BLANK, " "))


def tokens(c: Column) -> Column:
    """Array of word tokens; a hyphen splits, an inner apostrophe does not."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_key(token: Column) -> Column:
    """``lookup_key`` of a token: there are no blanks or underscores in one, so none are looked for."""
    return F.replace(F.lower(F.translate(token, "’‘ʼ", "'''")), F.lit("ß"), F.lit("ss"))


def sound_key(c: Column) -> Column:
    """Key of words that sound alike: folds, first letter (vowels as a), then consonants without doubles."""
    x = F.regexp_replace(F.lower(c), "[^a-z]", "")
    for pattern, by in SOUND_FOLDS:
        x = F.regexp_replace(x, pattern, by)
    head = F.substring(x, 1, 1)
    head = F.when(head.rlike("[aeiouy]"), "a").otherwise(head)
    rest = F.regexp_replace(F.substring(x, 2, 1_000_000), "[aeiouyhw]", "")
    return F.regexp_replace(F.concat(head, rest), r"(.)\1+", "$1")


def inflections(lemma: Column, pos: Column) -> Column:
    """Regular spellings of a one-word lemma; several words have none."""
    n = F.length(lemma)
    last = F.substring(lemma, -1, 1)
    body = F.left(lemma, n - 1)
    on = lambda *ends: [F.concat(lemma, F.lit(e)) for e in ends]
    double = lambda *ends: [F.concat(lemma, last, F.lit(e)) for e in ends]
    y = lambda e: F.when(last == "y", F.concat(body, F.lit(e)))
    noun = F.array(*on("s", "es", "'s"), y("ies"))
    verb = F.array(*on("ed", "d", "ing"), *double("ed", "ing"), F.when(last == "e", F.concat(body, F.lit("ing"))), y("ied"))
    grade = F.array(*on("er", "est", "r", "st"), *double("er", "est"), y("ier"), y("iest"))
    none = F.array().cast("array<string>")
    forms = F.when(pos == "n", noun).when(pos == "v", F.concat(noun, verb)).when(pos.isin("a", "s", "r"), grade).otherwise(none)
    return F.when(lemma.contains(" ") | (n == 0), none).otherwise(F.array_distinct(F.array_compact(forms)))


def british_variants(c: Column) -> Column:
    """Likely British spellings of an American word."""
    first = F.when(c.contains("or"), F.regexp_replace(c, "^(.*?)or", "$1our"))
    parts = [
        first,
        F.when(c.endswith("er"), F.regexp_replace(c, "er$", "re")),
        F.when(c.contains("gray"), F.replace(c, F.lit("gray"), F.lit("grey"))),
        F.when(c.endswith("og"), F.concat(c, F.lit("ue"))),
    ]
    return F.array_compact(F.array(*parts))


def blocked(key: Column, words: list[str], whole_only: list[str], inside: list[str], allow: list[str] = (), phrases: list[str] = ()) -> Column:
    """Unfit key: allowed first, then listed, then a listed word in a phrase, then a listed stem anywhere."""
    k = F.translate(key, "’", "'")
    inner = [w for w in words if w not in set(whole_only)]
    parts = F.filter(F.split(k, r"[ \-'/.]+"), lambda t: t.isin(inner))
    stem = F.lit(False)
    for s in inside:
        stem = stem | k.contains(s)
    return F.when(k.isin(list(allow)), False).otherwise(k.isin([*words, *phrases]) | (F.size(parts) > 0) | stem)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of the Wilson score interval, not rounded; (0, 0) without trials."""
    p, zz = k / n, F.lit(z * z)
    low_n = F.lit(1.0) + zz / n
    centre = (p + zz / (F.lit(2.0) * n)) / low_n
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + zz / (F.lit(4.0) * n * n)) / low_n
    zero = F.lit(0.0)
    return F.struct(F.when(n > 0, centre - half).otherwise(zero).alias("low"), F.when(n > 0, centre + half).otherwise(zero).alias("high"))


def word_of(identifier: Column) -> Column:
    """What stands before the last hyphen of an id."""
    return F.regexp_extract(identifier, "^(.*)-[^-]*$", 1)


# fixed values: names of the parts of speech
POS_CODES = {"n": "n", "noun": "n", "v": "v", "verb": "v", "a": "a,s", "s": "a,s", "adj": "a,s", "adjective": "a,s", "r": "r", "adv": "r", "adverb": "r"}
#: Licenses by their address without scheme, www and final slash.
LICENSE_NAMES = {"creativecommons.org/licenses/by/4.0": "Creative Commons Attribution 4.0 International (CC BY 4.0)"}


def normalise_pos(c: Column) -> Column:
    """Array of codes of a part of speech; empty for null, an error for an unknown name."""
    name = F.lower(F.trim(c))
    out = F.when(c.isNull(), F.array().cast("array<string>"))
    for alias, codes in POS_CODES.items():
        out = out.when(name == alias, F.array(*[F.lit(x) for x in codes.split(",")]))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown part of speech "), c)).cast("array<string>"))


def license_name(url: Column) -> Column:
    """Label of a license address, else the address itself, else unknown."""
    bare = F.rtrim(F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://(www\.)?", ""), F.lit("/"))
    out = F.when(F.coalesce(url, F.lit("")) == "", "unknown")
    for address, label in LICENSE_NAMES.items():
        out = out.when(bare == address, label)
    return out.otherwise(url)


def edge_strip(c: Column) -> Column:
    """A word without the runs of other characters before and behind it."""
    inner = r"[\p{L}\p{M}\p{N}_]"
    first = F.regexp_extract(c, rf"({inner}.*)$", 1)
    return F.regexp_extract(first, rf"^(.*{inner})", 1)


def word_shape(c: Column) -> Column:
    """Whether a text is one or more words: letters first, joined by blanks, apostrophes, stops or hyphens."""
    letter = r"[\p{L}\p{Nl}\p{No}]"
    return c.rlike(rf"^{letter}[\p{{L}}\p{{M}}\p{{Nl}}\p{{No}}]*([ '’.-]+{letter}+)*\.?$")


def sentence_around(text: Column, offset: Column) -> Column:
    """The sentence that holds a character offset: it ends at . ! ? unless a lower-case letter follows (past closing
    quotes, brackets and blanks), or at a blank line; squashed, without quotes around it; empty for an empty text."""
    n = F.length(text)
    at = F.least(F.greatest(offset, F.lit(0)), n - 1)
    # Every end is marked behind its character, so that offsets can be counted without the marks.
    marked = F.regexp_replace(text, r"([.!?])(?![\"”’)]*[ \n]*\p{Ll})|(\n)(?=\n)", "$1$2\u0001")
    parts = F.split(marked, "\u0001", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(x)))
    place = F.size(F.filter(ends, lambda e: e <= at))
    said = F.regexp_replace(F.coalesce(F.get(parts, F.least(place, F.size(parts) - 1)), F.lit("")), r"\s+", " ")
    return F.when(n > 0, F.trim(said, F.lit(' "“”'))).otherwise(F.lit(""))
