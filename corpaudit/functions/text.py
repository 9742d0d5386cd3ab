"""Scalar functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words too common to carry content.
STOP_WORDS = (
    "the a an and or but if then than to of in on for with as at by from is are was were be been being it this that these those we you they he she i our your "
    "their his her its not can could should would may might will do does did have has had into about over under between such using use used also more most some "
    "any all each other another which who what when where why how through within without during per via among because therefore however thus while whereupon upon "
    "there here very much many few both either neither same own just only"
).split()
#: A word for counting, with inner apostrophes, points and hyphens.
COUNTED_WORD = r"[\p{L}\p{N}]+(?:['’.-][\p{L}\p{N}]+)*"
#: Characters that other engines count as white space and Java's \s does not.
ODD_SPACES = "                 　﻿"


def plain_spaces(text: Column) -> Column:
    """Unicode spaces as ordinary ones, so that patterns with \\s see them."""
    return F.translate(text, ODD_SPACES, " " * len(ODD_SPACES))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    # where a pattern's end may stand before a last line separator, the pattern decides
    odd_end = F.right(text, F.lit(1)).isin("\u0085", "\u2028", "\u2029")
    return F.when(odd_end, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(F.btrim(text, F.lit(" \t\n\x0b\f\r")))


def excerpt(text: Column, size: int = 80) -> Column:
    short = squeeze(text)
    return F.when(F.length(short) > size, F.concat(F.substring(short, 1, size - 1), F.lit("…"))).otherwise(short)


def word_list(text: Column) -> Column:
    """Runs of letters, digits and apostrophes, in lower case and order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))


def content_words(words: Column) -> Column:
    # a set of literals is hashed, an array of them is gone through for every word
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def split_count(text: Column) -> Column:
    """Words between white space; one for an empty text, as a split gives."""
    return F.size(F.split(strip(text), r"\s+"))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(COUNTED_WORD)), F.lit(0))


def confidence_score(word: Column) -> Column:
    return F.when(word == "high", 0.95).when(word == "medium", 0.75).otherwise(0.5)


def name_key(name: Column) -> Column:
    """Names compared: lower case, plain apostrophes, no full stops, single spaces."""
    return squeeze(F.replace(F.translate(F.lower(name), "’", "'"), F.lit("."), F.lit("")))


def year_base(year: Column) -> Column:
    return F.regexp_replace(year, "[a-z]$", "")


def title_tokens(title: Column) -> Column:
    """Distinct words of more than two characters, for title overlap."""
    cleaned = F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.filter(F.split(squeeze(cleaned), " "), lambda w: F.length(w) > 2))


def title_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def author_names(authors: Column) -> Column:
    """Family and given names as 'Family, G.' joined for display."""
    one = lambda a: F.concat_ws(", ", a["family"], F.regexp_replace(a["given"], r"(\p{L})\p{L}*\.?", "$1."))
    return F.array_join(F.transform(authors, one), ", ")


def alphanumerics(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def safe_name(name: Column) -> Column:
    """Last part of a path, unusual characters as _, 120 characters."""
    last = F.substring_index(F.substring_index(name, "/", -1), "\\", -1)
    return F.substring(F.regexp_replace(last, r"[^A-Za-z0-9._ -]", "_"), 1, 120)


def title_case_like(text: Column) -> Column:
    """Three fifths of the words of over three characters begin with a capital."""
    long_ = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 3)
    capital = F.filter(long_, lambda w: w.rlike("^[A-ZÀ-Þ]"))
    return (F.size(long_) == 0) | (F.size(capital) / F.size(long_) >= 0.6)


#: Words that stay low inside titles, acronyms, what of a word is its name, and names of mixed case.
MINOR = "a an and as at but by for in nor of on or per the to up via with yet".split()
ACRONYMS = "AI APA CPI EU GDP UK US USA".split()
NAME_IN_WORD, MIXED_CASE = r"^\W*([\p{L}\p{N}.''’-]+)\W*$", "[A-Z].*[A-Z]|[a-z][A-Z]"


def title_case(text: Column) -> Column:
    """Title case: minor words low unless first or last, acronyms in capitals, words of mixed case as they are.

    What a word becomes is looked up by its name in lower case, in a table for the ends of the title and one for its middle; other names take a capital.
    """
    ends = {a.lower(): a for a in ACRONYMS}
    tables = [F.create_map(*[F.lit(x) for pair in forms.items() for x in pair]) for forms in (ends, {m: m for m in MINOR} | ends)]
    words = F.transform(F.split(squeeze(text), " "), lambda w: F.struct(w.alias("word"), F.regexp_extract(w, NAME_IN_WORD, 1).alias("name")))

    def form(x: Column, i: Column) -> Column:
        low, at_end = F.lower(x["name"]), i.isin(0) | (i == F.size(words) - 1)
        known = F.when(at_end, F.try_element_at(tables[0], low)).otherwise(F.try_element_at(tables[1], low))
        capital = F.concat(F.upper(F.left(low, F.lit(1))), F.substr(low, F.lit(2)))
        stays = (x["name"] == "") | x["name"].rlike(MIXED_CASE)
        return F.when(stays, x["word"]).otherwise(F.replace(x["word"], x["name"], F.coalesce(known, capital)))

    return F.array_join(F.transform(words, form), " ")


def number_word(word: Column) -> Column:
    """One to twenty as a number; digits as they are; else null."""
    names = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    table = F.create_map(*[F.lit(x) for i, n in enumerate(names, 1) for x in (n, i)])
    return F.coalesce(F.when(word.rlike("^[0-9]+$"), word.cast("int")), table[F.lower(word)])


def twips_to_inches(twips: Column) -> Column:
    return F.format_string('%.2f"', twips / 1440.0)


def twips_to_points(twips: Column) -> Column:
    return F.format_string("%.1f pt", twips / 20.0)


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100.0)


def suggested_name(file_name: Column) -> Column:
    """A heading from a file name: no extension, dashes and underscores as spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]+$", ""), "[_-]+", " "))
