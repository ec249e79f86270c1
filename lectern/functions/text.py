"""Text transforms as Column functions: marks, markup, names, file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of Hebrew marks.
MARKS = r"[֑-ׇ]"
CANTILLATION = r"[֑-֯]"
VOWELS = r"[ְ-ֽׁׂׅׄ]"


def remove_marks(c: Column) -> Column:
    """Deletes U+0591 to U+05C7, the hyphen U+05BE included."""
    return F.regexp_replace(c, MARKS, "")


def is_mark(c: Column) -> Column:
    return c.rlike(f"^{MARKS}$")


def strip_tags(c: Column) -> Column:
    """Text outside of tags; character references stay (see strip_html)."""
    return F.regexp_replace(c, "<[^>]*>", "")


def strip_html(c: Column) -> Column:
    """Text outside of tags with the common character references decoded."""
    out = strip_tags(c)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def searchable(c: Column) -> Column:
    """The form that in-book search compares: no tags, no marks, lower case."""
    return remove_marks(F.lower(strip_tags(c)))


def plain_term(query: str) -> str:
    """A query in the same form."""
    return re.sub(MARKS, "", re.sub("<[^>]*>", "", query).lower())


def display_filter(c: Column, state: int) -> Column:
    """0 as it is; 1 without cantillation; 2 without vowels too, `?` and `!` become `.`, the em dash goes. Text between tags only."""
    if state <= 0:
        return c
    out = F.regexp_replace(c, CANTILLATION, "")
    if state > 1:
        outside = r"(?![^<]*>)"
        out = F.regexp_replace(out, VOWELS, "")
        out = F.regexp_replace(out, "[?!]" + outside, ".")
        out = F.regexp_replace(out, "—" + outside, "")
    return out


def censor(c: Column, strict_exempt: bool = False) -> Column:
    """Rewrites divine names letter by letter, marks kept; the patterns and their order are fixed values. strict_exempt leaves the plural before `others` alone in the shorter form too."""
    d = f"({MARKS}*)"
    others = r"(?!\s*א" + f"{MARKS}*ח{MARKS}*ר{MARKS}*י{MARKS}*ם)"
    out = F.regexp_replace(c, f"י{d}ה{d}ו{d}ה{d}", "י$1ק$2ו$3ק$4")
    out = F.regexp_replace(out, f"א{d}ד{d}נ{d}י{d}", "א$1ד$2נ$3-י$4")
    out = F.regexp_replace(out, f"א{d}ל{d}ה{d}י{d}ם{d}{others}", "א$1ל$2ק$3י$4ם$5")
    out = F.regexp_replace(out, f"א{d}ל{d}ו{d}ה{d}י{d}ם{d}{others}", "א$1ל$2ו$3ק$4י$5ם$6")
    keep = "(?!ם)" if strict_exempt else ""
    out = F.regexp_replace(out, f"א{d}ל{d}ה{d}י{d}{keep}", "א$1ל$2ק$3י$4")
    return F.regexp_replace(out, f"א{d}ל{d}ו{d}ה{d}(?![יםא])", "א$1ל$2ו$3ק$4")


def highlight(c: Column, query: str) -> Column:
    """Wraps leftmost matches in <mark>; marks between the letters of the query are allowed."""
    if not query:
        return c
    pattern = "".join(f"\\Q{ch}\\E{MARKS}*" for ch in query)
    return F.regexp_replace(c, f"(?iu){pattern}(?![^<]*>)", "<mark>$0</mark>")


def sanitize_file_name(c: Column) -> Column:
    """Without characters that file names can't hold, 100 characters at most; `unknown` if nothing is left."""
    out = F.left(F.regexp_replace(c, r'[\x00-\x1F"<>|:*?\\/]', ""), F.lit(100))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("unknown"))


def tag_separator(c: Column) -> Column:
    return F.replace(c, F.lit(";"), F.lit(" \\ "))


def tag_array(c: Column) -> Column:
    """Trimmed, non-empty tags of a string parted by backslashes."""
    return F.filter(F.transform(F.split(c, r"\\"), lambda t: F.trim(t)), lambda t: F.length(t) > 0)


def joined_list(c: Column) -> Column:
    return F.concat(F.array_join(c, " \\ "), F.lit(" "))


def first_word(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def remove_breaks(c: Column) -> Column:
    """Without a tab before a paragraph's end, and line breaks (vertical tab) with what tabs or hard spaces follow."""
    return F.regexp_replace(F.regexp_replace(c, "\t(?=\n|$)", ""), "\u000b[\t ]?", "")


def footnote_space(c: Column) -> Column:
    """A hard space between a word and the mark of a footnote (U+0002)."""
    return F.regexp_replace(c, " *\u0002 *", " \u0002")


def quoted_name(c: Column) -> Column:
    """The first name in single quotes, or the text itself."""
    return F.coalesce(F.nullif(F.regexp_extract(c, "'([^']+)'", 1), F.lit("")), c)


def direction(c: Column, default: str = "ltr") -> Column:
    """rtl with a Hebrew or Arabic letter, ltr with any other word character, else the default."""
    return F.when(c.rlike(r"[\p{InHebrew}\p{InArabic}]"), "rtl").when(c.rlike(r"(?U)\w"), "ltr").otherwise(default)


def heading_level(c: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(6), c + 2))


#: Labels of connection kinds. Fixed values.
LABELS = {"SOURCE": "מקור", "OTHER": "אחר", "COMMENTARY": "מפרשים", "TARGUM": "תרגומים", "REFERENCE": "קשרים"}


def connection_label(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), c), c)
