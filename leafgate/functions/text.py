"""Column functions on text: the ordered cleaning chain, splitting, counting and names.

All stay in the JVM. Patterns say (?U) wherever a word, space or digit class is meant for all of Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Upper-case words that stay. Fixed values.
ACRONYMS = (
    "AI", "ML", "UK", "US", "EU", "UN", "NATO", "FBI", "CIA", "NASA", "CEO", "CFO", "CTO", "HR", "IT", "PR", "ID", "OK", "TV", "PC", "USB", "PDF", "MP3", "TTS", "GPU",
    "CPU", "RAM", "API", "URL", "HTML", "CSS", "SQL", "GMT", "EST", "PST", "BC", "AD", "WWII", "WWI", "USA", "UAE", "PTSD", "DNA", "RNA", "VIP", "RSVP",
)
#: Forms of a heading line, each from the line's start, whatever the case. Fixed values.
HEADINGS = (
    r"chapter\s+[\divxlcdm]+",
    r"chapter\s+\w+",
    r"part\s+[\divxlcdm]+",
    r"part\s+\w+",
    r"\d+\.\s+[A-Z]",
    r"epilogue$",
    r"prologue$",
    r"introduction$",
    r"preface$",
    r"foreword$",
    r"appendix",
    r"conclusion$",
)
HEADING_LIMIT = 80
NAME_LIMIT = 50
_LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def text_or_empty(t: Column | str) -> Column:
    return F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit(""))


def join_hyphens(t: Column) -> Column:
    """A hyphen at a line's end before a word character goes, with the line end."""
    return F.regexp_replace(t, r"(?U)-\n(\w)", "$1")


def drop_numeric_lines(t: Column) -> Column:
    return F.regexp_replace(t, r"(?mdU)^\s*\d+\s*$", "")


def squeeze_blank_lines(t: Column) -> Column:
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def squeeze_spaces(t: Column) -> Column:
    return F.regexp_replace(t, r"[ \t]+", " ")


def strip_controls(t: Column) -> Column:
    """Tab, line feed and carriage return stay."""
    return F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


_MARK = "\uffff"  # no character: texts that hold it all the same go the slower way


def _calm(w: Column, stays: Column) -> Column:
    return F.when(stays, w).otherwise(F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1 << 30))))


def deshout(t: Column, acronyms: list[str] | tuple[str, ...] | Column = ACRONYMS) -> Column:
    """Whole words of three or more A-Z keep only their first capital, unless they are acronyms (values, or a column of arrays). Texts without three capitals in a row pass as they are."""
    stays = (lambda w: F.array_contains(acronyms, w)) if isinstance(acronyms, Column) else (lambda w: w.isin(*acronyms))
    parts = F.split(F.regexp_replace(t, r"(?U)(?=[A-Z]{3})\b([A-Z]{3,})\b", f"{_MARK}$1{_MARK}"), _MARK)  # every second one is such a word
    marked = F.array_join(F.transform(parts, lambda w, i: F.when(i % 2 == 1, _calm(w, stays(w))).otherwise(w)), "")
    every = F.array_join(F.transform(F.split(t, r"(?U)\b"), lambda w: F.when(w.rlike("^[A-Z]{3,}$"), _calm(w, stays(w))).otherwise(w)), "")
    return F.when(~t.rlike("[A-Z]{3}"), t).when(t.contains(_MARK), every).otherwise(marked)


def shouted_words(t: Column) -> Column:
    """The distinct words that deshout looks at."""
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?U)\b([A-Z]{3,})\b"), F.lit(1)))


def strip_ends(t: Column) -> Column:
    """Only texts that begin or end with white space are searched through, and a run of it only from its start."""
    first, last = (F.substring(t, n, 1).rlike(r"(?U)\s") for n in (1, -1))
    return F.when(first | last, F.regexp_replace(t, r"(?U)^\s+|(?<!\s)\s++\z", "")).otherwise(t)


def clean(t: Column) -> Column:
    """The chain; its order matters, and it is not idempotent."""
    for step in (join_hyphens, drop_numeric_lines, squeeze_blank_lines, squeeze_spaces, strip_controls, deshout, strip_ends):
        t = step(t)
    return t


def split_lines(t: Column) -> Column:
    """Lines by any Unicode line end; none after the last end, none in an empty text."""
    ended = F.substring(t, -1, 1).rlike(_LINE_ENDS)
    whole = F.when(ended, F.regexp_replace(t, f"(?:{_LINE_ENDS})\\z", "")).otherwise(t)  # the last line's end opens no further line
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(whole, _LINE_ENDS))


def split_sentences(t: Column) -> Column:
    return F.split(t, r"(?U)(?<=[.!?])\s+")


def word_count(t: Column) -> Column:
    return F.size(F.filter(F.split(t, r"(?U)\s+"), lambda x: x != ""))


def is_heading(line: Column) -> Column:
    return is_stripped_heading(strip_ends(line))


def is_stripped_heading(s: Column) -> Column:
    """The same of a line whose ends are stripped."""
    return (F.length(s) <= HEADING_LIMIT) & s.rlike(f"(?iU)^(?:{'|'.join(HEADINGS)})")


def safe_name(n: Column, title: Column) -> Column:
    """Two-digit number, then the title's word characters, spaces and hyphens, cut at NAME_LIMIT."""
    kept = strip_ends(F.substring(F.regexp_replace(title, r"(?U)[^\w\s-]", ""), 1, NAME_LIMIT))
    return F.concat(F.format_string("%02d_", n), kept, F.lit(".mp3"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def kilobytes(length: Column) -> Column:
    return F.floor(length / 1024).cast("long")


def megabytes(length: Column) -> Column:
    return F.round(length / 1048576, 1)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def clip_name(ts: Column) -> Column:
    return F.concat(F.lit("clip_"), F.date_format(ts, "yyyyMMdd_HHmmss"))
