"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII that engines' ``\\s`` does not match.
WIDE_SPACE = "[\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\u0085]"


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, WIDE_SPACE, " "), "\\s+", " "))


def strip_tags(html: Column) -> Column:
    """Markup removed; an unclosed tag drops the rest, a stray ``>`` is dropped too."""
    return F.replace(F.regexp_replace(html, "<[^>]*(>|\\z)", ""), F.lit(">"), F.lit(""))


def normalize(html: Column) -> Column:
    """Tags stripped, white space collapsed."""
    return collapse_space(strip_tags(html))


def html_text_runs(html: Column) -> Column:
    """Untrimmed text between tags, blank runs dropped."""
    return F.filter(F.split(html, "<[^>]*>"), lambda run: F.trim(F.regexp_replace(run, "\\s+", " ")) != "")


def html_row_texts(html: Column) -> Column:
    """One text per list or table row: its trimmed cells joined by a blank."""
    rows = F.regexp_extract_all(html, F.lit("(?s)<li>(.*?)</li>"), F.lit(1))
    return F.transform(rows, normalize)


def escape_html(text: Column) -> Column:
    """& < > and the double quote as entities."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def sql_quote(text: Column) -> Column:
    """A PostgreSQL literal; the escape form only where a backslash or control character asks for it."""
    doubled = F.replace(text, F.lit("'"), F.lit("''"))
    escaped = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")), doubled)
    special = F.contains(text, F.lit("\\")) | F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    return F.when(special, F.concat(F.lit("e'"), escaped, F.lit("'"))).otherwise(F.concat(F.lit("'"), doubled, F.lit("'")))


def snippet(text: Column, needle: Column, before: int = 40, size: int = 160) -> Column:
    """``size`` characters from ``before`` characters ahead of the first case-insensitive hit; from 0 without one."""
    hit = F.instr(F.lower(text), F.lower(needle))
    return F.trim(F.replace(F.substring(text, F.greatest(hit - before, F.lit(1)), F.lit(size)), F.lit("\n"), F.lit(" ")))


def contact_kind(label: Column, name: Column) -> Column:
    """email, phone or none, by the label; by the name only where the label is empty; email goes first."""
    probe = F.lower(F.when(F.trim(label) == "", name).otherwise(label))
    denied = probe.rlike("privat|mobiltel")
    return F.when(probe.rlike("e-?mail|courriel|correo"), "email").when(denied, "none").when(probe.rlike("tel|phone|fax|mobil"), "phone").otherwise("none")


def inline_date(text: Column) -> Column:
    """The first inline date blank such as ``01. .`` or ``01..2024``, else the empty text."""
    return F.regexp_extract(text, "\\d{1,2}\\.\\s*\\.\\s*\\d*", 0)


def is_date_placeholder(text: Column) -> Column:
    """Three date parts (letters or up to four digits) with ``.``, ``/`` or ``-`` between."""
    part = "(dd?|tt?|mm?|yyyy|yy?|jjjj|jj?|[0-9]{1,4})"
    return F.lower(F.trim(text)).rlike(f"^{part}[./-] ?{part}[./-] ?{part}[./-]?$")


def is_placeholder(text: Column) -> Column:
    """Three or more fill characters and nothing else."""
    return F.trim(text).rlike("^[._…\\-–—]{3,}$")


def list_marker(text: Column) -> Column:
    """Kind of the list marker at the start of a line, else none."""
    return (
        F.when(text.rlike("^[-•–*] "), "bullet")
        .when(text.rlike("^[0-9]{1,2}(\\.[0-9]{1,2}){1,3}\\.? "), "multilevel")
        .when(text.rlike("^[0-9]{1,3}[.)] "), "numeric")
        .when(text.rlike("^\\(([ivxlc]+|[IVXLC]+)\\) "), "paren_roman")
        .when(text.rlike("^\\([A-Za-z0-9]\\) "), "paren")
        .when(text.rlike("^([ivxlc]{2,}|[IVXLC]{2,})[.)] "), "roman")
        .when(text.rlike("^[A-Za-z][.)] "), "letter")
        .otherwise("none")
    )


def numeric_prefix(text: Column) -> Column:
    """Leading digits with their ``.`` or ``)``."""
    return F.regexp_extract(text, "^[0-9]+[.)]", 0)


def name_words(text: Column) -> Column:
    """ASCII alphanumeric parts of a name."""
    return F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: w != "")


def snake_case(text: Column) -> Column:
    """Parts in lower case joined by ``_``; unknown if there are none."""
    words = name_words(text)
    return F.when(F.size(words) == 0, "unknown").otherwise(F.lower(F.array_join(words, "_")))


def pascal_case(text: Column) -> Column:
    """Parts with a capital; all-capital parts stay; Unknown if there are none."""
    words = name_words(text)
    one = lambda w: F.when(w == F.upper(w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.when(F.size(words) == 0, "Unknown").otherwise(F.array_join(F.transform(words, one), ""))


def truncate_camel(text: Column, most: int) -> Column:
    """Names of over ``most`` characters cut before the last capital within reach, or at ``most`` without one."""
    head = F.substring(text, 1, most)
    short = F.regexp_extract(head, "^(.+)[A-Z]", 1)
    return F.when(F.length(text) <= most, text).when(short != "", short).otherwise(head)


def is_single_sentence(text: Column) -> Column:
    """Not empty and at most one sentence: one end mark only at the end, or several of which none but the last has a
    capitalised word behind it. Marks beside digits, those of a short leading letter label and those between capitals
    of an abbreviation end nothing."""
    body = F.regexp_replace(F.trim(text), "^\\p{L}{1,4}\\.", "")
    body = F.regexp_replace(F.regexp_replace(body, "([0-9])[.!?]", "$1,"), "[.!?]([0-9])", ",$1")
    ends = F.regexp_count(body, F.lit("[.!?]"))
    one = F.when(ends == 0, True).when(ends == 1, body.rlike("[.!?]\\z"))
    return (F.trim(text) != "") & one.otherwise(~body.rlike("(?s)[.!?]\\s*\\p{Lu}+([!?]|[^.\\p{Lu}].*[.!?])"))


def strip_lang_suffix(text: Column) -> Column:
    """A language suffix in one case removed."""
    return F.regexp_replace(text, "_(DE|EN|FR|IT|ES|de|en|fr|it|es)$", "")


def name_prefix(text: Column) -> Column:
    """The part before the first underscore, or all of it."""
    return F.substring_index(text, "_", 1)


def dimension_points(text: Column) -> Column:
    """A length with an optional unit in points; null if it is not one."""
    value = F.regexp_extract(text, "^(-?[0-9]+(?:\\.[0-9]+)?)(pt|in|mm|cm|)$", 1)
    unit = F.regexp_extract(text, "^(-?[0-9]+(?:\\.[0-9]+)?)(pt|in|mm|cm|)$", 2)
    factor = F.when(unit == "in", 72.0).when(unit == "mm", 2.834645669291339).when(unit == "cm", 28.34645669291339).otherwise(1.0)
    return F.when(value != "", F.try_to_number(value, F.lit("S999999.999999")).cast("double") * factor)


def content_hash(digests: Column) -> Column:
    """Order-independent hash of a set of hex digests."""
    return F.sha2(F.array_join(F.array_sort(digests), ""), 256)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two (unit) vectors, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Fixed value: the namespace of addresses in RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version-5 identifier of a name: a SHA-1 digest with the version in digit 13 and the variant in the top bits of digit 17."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab" * 4), F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)), F.lit(1))
    return F.when(name.isNotNull(), F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)))
