"""Text rules: cleaning, standardising, phones, zip codes, e-mail and addresses."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.errors import message, unless_message

#: Letters that are dropped inside long words, and little words that are dropped first.
VOWELS, STOP_WORDS = "aeiou", ["a", "an", "and", "at", "by", "for", "in", "of", "on", "or", "the", "to", "with"]


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def same(left: Column, right: Column) -> Column:
    """Equal without regard to case and outer blanks."""
    return F.lower(F.trim(left)) == F.lower(F.trim(right))


def remove_punctuation(value: Column, level: int = 0, keep: str = "") -> Column:
    """Punctuation becomes a blank (level 0), goes (1), or goes with all blanks (2); ``keep`` is spared."""
    marks = "".join(f"\\{c}" for c in keep)
    out = F.regexp_replace(value, f"[^A-Za-z0-9 {marks}]", " " if level == 0 else "")
    if level == 2:
        return F.regexp_replace(out, " +", "")
    return F.trim(F.regexp_replace(out, " +", " "))


def replace_words(value: Column, words: dict[str, str]) -> Column:
    """Whole words, in any case, by ``words``; longer keys first."""
    for word in sorted(words, key=lambda w: (-len(w), w)):
        value = F.regexp_replace(value, rf"(?i)\b{re.escape(word)}\b", words[word].replace("\\", "\\\\").replace("$", "\\$"))
    return value


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def standard_value(value: Column, synonyms: dict[str, list[str]], otherwise: Column | None = None) -> Column:
    """The standard key whose synonyms hold the value, else ``otherwise`` (the value); messages pass."""
    pairs = [(s.lower(), key) for key, names in synonyms.items() for s in [key, *names]]
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(dict(reversed(pairs)).items())))
    return unless_message(value, F.coalesce(F.element_at(table, F.lower(F.trim(value))), value if otherwise is None else otherwise))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def phone(value: Column, text: str = "Invalid phone number") -> Column:
    """Ten digits, after an optional leading 1; anything else that is not blank is a clarification."""
    bare = F.regexp_replace(digits(value), "^1(?=[0-9]{10}$)", "")
    return unless_message(value, F.when(blank(value), F.lit("")).when(F.length(bare) == 10, bare).otherwise(message("C", text, value)))


def phone_extension(value: Column) -> Column:
    """The digits after ext, extn, extension or x."""
    return F.regexp_extract(F.lower(value), r"(?:extension|extn|ext|x)[.: ]*([0-9]+)\s*$", 1)


def zip5(value: Column, text: str = "Invalid zip code") -> Column:
    """The first five digits, with lost leading zeros put back (4 or 8 digits)."""
    bare = digits(value)
    full = F.when(F.length(bare).isin(4, 8), F.concat(F.lit("0"), bare)).otherwise(bare)
    return unless_message(value, F.when(F.length(full).isin(5, 9), F.substring(full, 1, 5)).otherwise(message("C", text, value)))


def zip4(value: Column) -> Column:
    bare = digits(value)
    return F.when(F.length(bare) == 9, F.substring(bare, 6, 4)).when(F.length(bare) == 8, F.substring(bare, 5, 4)).otherwise("")


def apply_regexes(value: Column, patterns: list[str]) -> Column:
    """Each pattern in turn; where it matches, its match is the new value."""
    for pattern in patterns:
        hit = F.regexp_extract(value, pattern, 0)
        value = F.when(hit != "", hit).otherwise(value)
    return value


def electronic_type(value: Column) -> Column:
    """W for a web address, E for an e-mail address, else blank."""
    return F.when(value.rlike(r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), "E").when(value.rlike(r"(?i)(https?://|www\.)"), "W").otherwise("")


def tokens(value: Column, delimiters: str = ",;&", whole_if: str | None = None) -> Column:
    """The non-blank parts between delimiters; a value that matches ``whole_if`` is one part."""
    cut = F.filter(F.transform(F.split(value, f"[{re.escape(delimiters)}]+"), lambda t: F.trim(t)), lambda t: t != "")
    return cut if whole_if is None else F.when(value.rlike(whole_if), F.array(F.trim(value))).otherwise(cut)


def zero_padded(value: Column, width: int) -> Column:
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)


def is_po_box(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?i)\bp\.?\s*o\.?\s*box\b|\bpost\s+office\s+box\b"), F.lit(False))


def name_parts(value: Column) -> Column:
    """last, first and middle of ``Last, First Middle`` or ``First Middle Last``."""
    value = F.regexp_replace(F.trim(value), r"\s+", " ")
    comma = value.contains(",")
    rest = F.split(F.when(comma, F.trim(F.regexp_extract(value, r",\s*(.*)$", 1))).otherwise(value), " ")
    last = F.when(comma, F.trim(F.regexp_extract(value, r"^([^,]*),", 1))).otherwise(F.element_at(rest, -1))
    middle = F.when(comma, F.array_join(F.slice(rest, 2, 100), " ")).otherwise(F.array_join(F.slice(rest, 2, F.greatest(F.size(rest) - 2, F.lit(0))), " "))
    return F.struct(last.alias("last"), F.get(rest, 0).alias("first"), middle.alias("middle"))


def age_limits(value: Column) -> Column:
    """min and max age of ``5-12``, ``18 and up`` or ``under 18``; blank where open."""
    low = F.lower(value)
    number = F.regexp_extract(low, "([0-9]+)", 1)
    pair = low.rlike("[0-9]+ *(-|to|thru|through) *[0-9]+")
    second = F.regexp_extract(low, "[0-9]+[^0-9]+([0-9]+)", 1)
    above, below = low.rlike("up|above|over|older|\\+"), low.rlike("under|below|younger|less")
    return F.struct(
        F.when(pair, number).when(above & ~below, number).otherwise("").alias("min_age"),
        F.when(pair, second).when(below, number).otherwise("").alias("max_age"),
    )


def abbreviate(value: Column, size: int, words: dict[str, str], text: str = "Too long") -> Column:
    """Fit into ``size``: squeeze blanks, abbreviate words, drop little words, drop inner vowels; else a clarification."""
    steps = [F.trim(F.regexp_replace(value, r"\s+", " "))]
    steps.append(replace_words(steps[-1], words))
    steps.append(F.trim(F.regexp_replace(F.regexp_replace(steps[-1], rf"(?i)\b({'|'.join(STOP_WORDS)})\b", ""), r"\s+", " ")))
    steps.append(F.regexp_replace(steps[-1], rf"(?i)(?<=\B)[{VOWELS}](?=\B)", ""))
    out = message("C", text, value)
    for step in reversed(steps):
        out = F.when(F.length(step) <= size, step).otherwise(out)
    return unless_message(value, out)


def without_vowels(value: Column) -> Column:
    return F.regexp_replace(value, f"(?i)[{VOWELS}]", "")


def acronym(value: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.filter(F.split(value, r"[^A-Za-z0-9]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))


def camel_words(value: Column) -> Column:
    """``officePhoneNo`` to ``office phone no``."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), "[_\\s]+", " ")))


def best_alias(value: Column, aliases: dict[str, list[str]], least: float = 75.0) -> Column:
    """field, alias and percent of the alias that a header matches best, if by ``least`` percent or more; the first listed of equals.

    The aliases are a dictionary of the program, so they are constants of the plan.
    """
    names = [(a, field) for field, own in aliases.items() for a in own]
    scored = F.array(*(F.struct(match_percent(F.lower(value), F.lit(a.lower())).alias("percent"), F.lit(-i).alias("number"), F.lit(field).alias("field"), F.lit(a).alias("alias")) for i, (a, field) in enumerate(names)))
    best = F.transform(F.array(F.array_max(scored)), lambda b: F.when(b["percent"] >= least, F.struct(b["field"].alias("field"), b["alias"].alias("alias"), b["percent"].alias("percent"))))
    return best[0]


def match_percent(left: Column, right: Column) -> Column:
    """100 less the edit distance in percent of the longer text."""
    longer = F.greatest(F.length(left), F.length(right), F.lit(1))
    return F.round(100.0 * (longer - F.levenshtein(left, right)) / longer, 4)


def joined_words(*values: Column) -> Column:
    """The values that aren't null or blank, with a blank between them."""
    return F.concat_ws(" ", *(F.when(~blank(v), v) for v in values))
