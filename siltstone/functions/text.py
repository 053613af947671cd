"""Column functions over text: tokens, normal forms, snippets, names, decline rules, ranges, hashes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .figures import DIGIT_WORDS, QUESTION_SCALES

TOKEN = r"[a-z]+|\d+(?:\.\d+)?"
#: Word lists of declining answers.
SOURCE_WORDS = "excerpt excerpts document documents context filing filings passage passages source sources material materials text".split()
FACT_WORDS = "information data detail details figure figures".split()
SAYING_WORDS = """contain contained provide provided include included mention mentioned specify specified state stated disclose disclosed report reported show shown give given present presented
have list listed break broken offer cover supply identify describe discuss indicate detail detailed address reference explain reveal available found""".split()
WORKING_WORDS = "determine determined calculate calculated compute computed answer answered derive derived identify identified assess assessed confirm confirmed verify verified quantify quantified".split()
GIVEN_WORDS = "provided available given included".split()
#: Marks of absence, legal suffixes that do not tell companies apart.
ABSENT = ("not in documents", "not_in_documents", "none", "n/a", "na", "unknown")
COMPANY_SUFFIXES = ("INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "COMPANIES", "LTD", "LIMITED", "LLC", "PLC", "LP", "HOLDINGS", "GROUP", "THE")
COMPANY_SUFFIX = f"(?: (?:{'|'.join(COMPANY_SUFFIXES)}))+$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def tokens(text: Column) -> Column:
    """Lower-cased words and numbers; a comma before exactly three digits of a number is dropped."""
    joined = F.regexp_replace(F.lower(text), r"(?<=\d),(?=\d{3}(?!\d))", "")
    return F.regexp_extract_all(joined, F.lit(f"({TOKEN})"), F.lit(1))


def normalise(text: Column) -> Column:
    """Lower-cased ASCII letters and digits only; the one letter whose lower case is two characters is none of them."""
    return F.regexp_replace(F.lower(F.replace(text, F.lit("İ"), F.lit(""))), "[^a-z0-9]", "")


def kept_offsets(text: Column) -> Column:
    """For each character of the normal form, where it stands in the text (0-based)."""
    places = F.transform(F.split(F.replace(text, F.lit("İ"), F.lit("_")), ""), lambda c, i: F.when(F.lower(c).rlike("^[a-z0-9]$"), i))
    return F.array_compact(places)


def find_all(haystack: Column, needle: str) -> Column:
    """All 0-based start positions of a needle, overlapping ones too.

    The text is split before every occurrence (a look-ahead takes no characters), and the
    lengths of the pieces are summed up: linear in the text, unlike a substring for each
    position.
    """
    if not needle:
        return F.array().cast("array<int>")
    pieces = F.split(haystack, "(?=" + re.escape(needle) + ")")
    sizes = F.transform(pieces, lambda p: F.length(p))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    summed = F.aggregate(sizes, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
    behind = F.slice(summed, 2, F.greatest(F.size(summed) - 1, F.lit(0)))
    return F.when(haystack.startswith(needle), summed).otherwise(behind)


def snippet(text: Column, most: int) -> Column:
    """White space collapsed to single spaces; cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def company_key(name: Column) -> Column:
    """Upper case, without a trailing ``/XX`` tag, points, commas and legal suffixes; letters and digits only."""
    upper = F.regexp_replace(F.upper(name), r"\s*/[A-Z]{2,}/?$", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(upper, "[.,]", ""), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(plain, COMPANY_SUFFIX, ""), "[^A-Z0-9]", "")


def document_name(name: Column) -> Column:
    """Struct (company, year, quarter, form) of ``COMPANY_2022_10K`` or ``COMPANY_2022Q1_10Q``; null where it does not fit."""
    pattern = r"^(.+)_(\d{4})(?:Q(\d))?_(.+)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    quarter = F.expr("null").cast("int")
    fields = F.struct(part(1).alias("company"), part(2).cast("int").alias("year"), F.when(part(3) != "", F.try_to_number(F.when(part(3) != "", part(3)), F.lit("9")).cast("int")).otherwise(quarter).alias("quarter"), part(4).alias("form"))
    return F.when(name.rlike(pattern), fields)


def fiscal_year(period_end: Column) -> Column:
    """Year of a period; one that ends in the first week of January belongs to the year before."""
    early = (F.month(period_end) == 1) & (F.dayofmonth(period_end) <= 7)
    return F.year(period_end) - F.when(early, 1).otherwise(0)


def year_end_month(period_end: Column) -> Column:
    early = (F.month(period_end) == 1) & (F.dayofmonth(period_end) <= 7)
    return F.when(early, 12).otherwise(F.month(period_end))


#: Own rule: what a denial, an inability and a want are called, once ``CONTRACTED`` phrases are one word.
CONTRACTED = (("can't", "cannot"), ("n't", " not"), ("can not", "cannot"), ("not possible", "impossible"), ("not enough", "insufficient"), ("not available", "unavailable"))
DENIALS, INABILITIES = ("not", "never"), ("cannot", "unable", "impossible")
WANTS, LOSSES = ("insufficient",), ("unavailable", "missing")
#: Words that may stand between a denial and what it denies, between an inability and its verb, between a want and its noun.
SAY_REACH, WORK_REACH, FACT_REACH = 3, 4, 3


def clause_words(text: Column) -> Column:
    """The clauses of a text (parted by points, semicolons and line ends) as lists of words, numbers and commas."""
    plain = F.lower(text)
    for short, long in CONTRACTED:
        plain = F.replace(plain, F.lit(short), F.lit(long))
    return F.transform(F.split(plain, r"[.;\n]"), lambda c: F.regexp_extract_all(c, F.lit("[a-z]+|[0-9]+|,"), F.lit(0)))


def _has(words: Column, some: Iterable[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in some]))


def _ahead(words: Column, i: Column, reach: int) -> Column:
    """The words behind place i (from 0), up to a comma."""
    found = F.slice(words, i + 2, reach)
    comma = F.array_position(found, ",").cast("int")
    return F.when(comma > 0, F.slice(found, 1, comma - 1)).otherwise(found)


def _denied(words: Column) -> Column:
    """In one clause: a denial just before a verb of saying where a source is named, an inability just before
    a verb of working out, or a want beside a noun for facts."""
    source = _has(words, SOURCE_WORDS) | (_has(words, FACT_WORDS) & _has(words, GIVEN_WORDS))

    def at(i: Column) -> Column:
        w = F.get(words, i)
        before = F.slice(words, F.greatest(i - FACT_REACH + 1, F.lit(1)), F.least(i, F.lit(FACT_REACH)))
        facts_ahead, facts_before = _has(_ahead(words, i, FACT_REACH), FACT_WORDS), _has(before, FACT_WORDS)
        rest = F.slice(words, i + 2, F.size(words))
        return (
            (w.isin(*DENIALS) & _has(_ahead(words, i, SAY_REACH), SAYING_WORDS) & source)
            | (w.isin(*INABILITIES) & _has(_ahead(words, i, WORK_REACH), WORKING_WORDS))
            | (w.isin(*WANTS) & facts_ahead)
            | (w.isin(*LOSSES) & (facts_before | source))
            | ((w == "no") & facts_ahead & (_has(rest, GIVEN_WORDS) | _has(rest, SOURCE_WORDS)))
        )

    return (F.size(words) > 0) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), at)


def declines(answer: Column) -> Column:
    """Whether a clause of an answer says that it cannot be given."""
    return F.exists(clause_words(answer), _denied)


def bare_token(answer: Column) -> Column:
    """The answer is nothing but a mark of absence."""
    return F.regexp_replace(F.lower(answer), r"^\W+|\W+$", "").isin(*ABSENT)


def answer_status(answer: Column, token: Column) -> Column:
    """answered, partial, declined or unparsed, by the rules alone."""
    opening = F.split(F.ltrim(F.regexp_replace(F.lower(answer), r"\W+", " ")), " ", 2)
    substance = answer.rlike(r"\d") | F.get(opening, F.lit(0)).isin("yes", "no")
    silent = F.when(token, "declined").otherwise("unparsed")
    said = F.when(token | declines(answer), F.when(substance, "partial").otherwise("declined")).otherwise("answered")
    return F.when(answer.isNull(), silent).when(bare_token(answer), "declined").otherwise(said)


def unit_hint(question: Column) -> Column:
    """Struct (scale, is_percent, decimals) of a question, read off its words by their neighbours."""
    words = F.split(F.trim(F.regexp_replace(F.replace(F.lower(question), F.lit("$"), F.lit(" usd ")), r"[^a-z0-9]+", " ")), " ")
    scales = F.create_map(*[F.lit(x) for pair in QUESTION_SCALES.items() for x in pair])
    digits = F.create_map(*[F.lit(x) for pair in (DIGIT_WORDS | {str(i): i for i in range(10)}).items() for x in pair])

    def at(w: Column, i: Column) -> Column:
        return F.coalesce(F.get(w, i), F.lit(""))

    def read(w: Column) -> Column:
        def scale(x: Column, i: Column) -> Column:
            money = at(w, i - 1).isin("usd", "dollar", "dollars")
            start = F.when(~money, i - 1).when(at(w, i - 2) == "us", i - 3).otherwise(i - 2)
            return F.when((at(w, start) == "in") | (at(w, i - 1) == "usd"), F.try_element_at(scales, F.rtrim(x, F.lit("s"))))

        def percent(x: Column, i: Column) -> Column:
            one, two = at(w, i - 1), at(w, i - 2)
            units = (one == "of") & (two.isin("unit", "units")) & x.isin("percent", "percents")
            return x.startswith("percent") & ((one == "in") | units | ((one == "a") & (two == "as") & x.isin("percent", "percentage")))

        def places(x: Column, i: Column) -> Column:
            rounding = F.exists(F.slice(w, F.greatest(i - 4, F.lit(1)), F.least(F.greatest(i - 2, F.lit(0)), F.lit(4))), lambda y: y.startswith("round"))
            return F.when(x.startswith("decimal") & (at(w, i - 2) == "to") & rounding, F.try_element_at(digits, at(w, i - 1)))

        first = lambda f: F.get(F.array_compact(F.transform(w, f)), F.lit(0))
        return F.struct(first(scale).alias("scale"), F.exists(F.transform(w, percent), lambda y: y).alias("is_percent"), first(places).alias("decimals"))

    # A lambda over an array of one binds the words, which are then made once.
    return F.element_at(F.transform(F.array(words), read), 1)


def canonical_key(*columns: Column) -> Column:
    """SHA-256 of the values joined by a bar: the same key for the same content."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def md5_int(*columns: Column) -> Column:
    """First eight hex digits of the MD5 of the values joined by a bar, as a number: a seeded draw without state."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("bigint")


def range_bounds(option: Column) -> Column:
    """Struct (lo, hi, strict) of ``>= x``, ``> x``, ``<= x``, ``< x``, ``a to b`` and ``a-b``; percent signs divide by 100."""
    scale = F.when(option.contains("%"), 0.01).otherwise(1.0)
    num = r"([0-9]+(?:\.[0-9]+)?)"
    one, two = rf"([<>]=?)\s*{num}", rf"{num}\s*%?\s*(?:to|-)\s*{num}"
    sign, x = F.regexp_extract(option, one, 1), F.nullif(F.regexp_extract(option, one, 2), F.lit("")).cast("double") * scale
    a, b = (F.nullif(F.regexp_extract(option, two, i), F.lit("")).cast("double") * scale for i in (1, 2))
    single = option.rlike(one)
    lo = F.when(single, F.when(sign.startswith(">"), x).otherwise(F.lit(float("-inf")))).otherwise(a)
    hi = F.when(single, F.when(sign.startswith("<"), x).otherwise(F.lit(float("inf")))).otherwise(b)
    return F.struct(lo.alias("lo"), hi.alias("hi"), (single & sign.isin("<", ">")).alias("strict"))


def cover_period(text: Column) -> Column:
    """Date after ``period ended`` on the first 5,000 characters, or null."""
    head = F.lower(F.regexp_replace(F.substring(text, 1, 5000), " ", " "))
    pattern = rf"(?:period|year|quarter) ended\s+({'|'.join(MONTHS)})\s+(\d{{1,2}}),\s*(\d{{4}})"
    part = lambda i: F.regexp_extract(head, pattern, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(1)).cast("int")
    day = F.lpad(part(2), 2, "0")
    return F.when(head.rlike(pattern), F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), day).try_cast("date"))


def strip_wrapper(raw: Column) -> Column:
    """From the first ``<html`` to the next ``</html>`` or the end; unchanged without one."""
    found = F.regexp_extract(raw, r"(?is)<html.*?(?:</html\s*>|\z)", 0)
    return F.when(found == "", raw).otherwise(found)
