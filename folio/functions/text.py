"""Text predicates and normalizations as Column functions: everything here stays in Catalyst."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it, with the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"
TOKEN = r"(?U)[^\s\x1c-\x1f]+"
WORDY = "[A-Za-z]{2,}"
#: Bullet characters; those of them at which text is split; phrases that head resume sections.
BULLETS = "•●▪◦–"
SPLIT_BULLETS = "•●▪◦"
RESUME_SECTIONS = (
    "summary", "professional summary", "profile", "objective", "about me",
    "experience", "work experience", "professional experience", "employment",
    "internships", "education", "projects", "personal projects",
    "skills", "technical skills", "certifications", "achievements",
    "awards", "coursework", "relevant coursework", "publications",
    "leadership", "extracurricular activities", "languages", "interests",
    "positions of responsibility", "volunteering",
)


def let(value: Column, f) -> Column:
    """f(value) with value computed once: inside a lambda an expression would be computed anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end (trim() only takes spaces)."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN)).cast("long")


def noise_ratio(c: Column) -> Column:
    """Share of tokens without two letters in a row; 1 without tokens."""
    t = tokens(c)
    return F.when(F.size(t) == 0, F.lit(1.0)).otherwise(F.size(F.filter(t, lambda x: ~x.rlike(WORDY))) / F.size(t))


def is_noisy(c: Column, limit: float = 0.5) -> Column:
    return noise_ratio(c) > limit


def dot_leaders(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:[ \t]*\.){4,}[ \t]*", " … ")


def block_lines(c: Column) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def normalize_heading(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z ]", " "), " +", " "))


def is_resume_section(c: Column) -> Column:
    """At most 40 characters, and every non-empty part between & / , or "and" is a known phrase."""
    parts = F.filter(F.transform(F.split(F.lower(c), r"\s*(?:&|/|,|\band\b)\s*"), normalize_heading), lambda x: x != "")
    known = F.array(*map(F.lit, RESUME_SECTIONS))
    return (F.length(c) <= 40) & (F.size(parts) > 0) & (F.size(F.array_except(parts, known)) == 0)


def is_upper(c: Column) -> Column:
    """Has cased characters and none in lower case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_bullet(c: Column) -> Column:
    return c.rlike(rf"^{SPACE}*[\-*{BULLETS}]")


def split_bullets(c: Column) -> Column:
    return F.filter(F.split(c, rf"\s*(?=[{SPLIT_BULLETS}])"), lambda x: strip(x) != "")


def is_resume_heading(c: Column) -> Column:
    s = strip(c)
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    return is_resume_section(s) | ((F.length(s) <= 40) & (letters >= 4) & is_upper(s) & ~is_bullet(s))


def is_prose_heading(c: Column) -> Column:
    s, n = strip(c), word_count(c)
    return (
        F.when((s == "") | (n > 15) | s.rlike("[.,;:]$"), F.lit(False))
        .when(s.rlike(r"^\d{1,3}(\.\d{1,3})*\.?\s+[A-Z]"), s.rlike(r"^\d{1,3}(\.\d{1,3})+\s") | (n <= 8))
        .when(s.rlike(r"(?i)^(chapter|appendix|part)\s+(?U)[\w.]+") & (n <= 10), F.lit(True))
        .otherwise(is_upper(s) & s.rlike("[A-Za-z]{3,}") & (n <= 8))
    )


def keeps_prose(c: Column) -> Column:
    """Captions, equations, and text that is mostly words."""
    return c.startswith("Figure") | c.startswith("Table") | c.contains("=") | (noise_ratio(c) <= 0.5)


def ends_sentence(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+$", "").rlike("[.!?]$")


def starts_lower(c: Column) -> Column:
    first = F.substring(c, 1, 1)
    return first.rlike(r"^\p{Ll}")


def wraps_previous(previous: Column, line: Column) -> Column:
    return starts_lower(line) | ~ends_sentence(previous)


def with_heading(heading: Column, body: Column) -> Column:
    return F.when(heading != "", F.concat(heading, F.lit("\n"), body)).otherwise(body)


def sentences(c: Column, max_words: int = 200) -> Column:
    """Sentences ending in . ! or ? before white space, each cut into pieces of at most max_words words."""
    marked = F.split(F.regexp_replace(strip(c), r"([.!?])\s+", "$1\u0000"), "\u0000")
    cut = lambda w: F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(w), F.lit(1)) - 1) / max_words).cast("int")),
        lambda k: F.array_join(F.slice(w, k * max_words + 1, F.lit(max_words)), " "))
    pieces = F.flatten(F.transform(marked, lambda s: let(tokens(s), cut)))
    return F.filter(pieces, lambda x: x != "")


def bm25_tokens(c: Column) -> Column:
    """ASCII letters and digits, in lower case: an accented letter ends a token."""
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, which Catalyst has no function for; ASCII texts pass as they are."""
    for s in batches:
        yield s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc_batches(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for the column name of whole rows, for mapInArrow."""
    for b in batches:
        texts = [x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in b.column(name).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, f.type) if f.name == name else c for f, c in zip(b.schema, b.columns)], b.schema.names)


def evidence_text(c: Column) -> Column:
    """For comparison of evidence: lower case, letters and digits only. Apply nfkc() first where texts need it."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def vocabulary(c: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)), F.lower))


def join_hyphenated(c: Column, words: Column) -> Column:
    """At each hyphen before a line break between words: joined if the joined word is in words, else the hyphen stays and the break goes.

    Left to right without overlap: a part that is one word and closed a match cannot open the next. Only flags are folded over the parts, so the
    work is linear in the text.
    """
    word, tail, head = r"(?U)^\w+$", r"(?U)\w+$", r"(?U)^\w+"
    rest = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))

    def flag(acc: Column, part: Column) -> Column:
        return F.struct((~acc["used"] & part.rlike(word)).alias("used"), F.concat(acc["open"], F.array(~acc["used"])).alias("open"))

    start = F.struct(F.lit(False).alias("used"), F.array().cast("array<boolean>").alias("open"))

    def joined(parts: Column, open_: Column, known_words: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            known = F.array_contains(known_words, F.lower(F.concat(F.regexp_extract(F.get(parts, i - 1), tail, 0), F.regexp_extract(part, head, 0))))
            return F.concat(F.when(i == 0, "").when(~F.get(open_, i - 1), "-\n").when(known, "").otherwise("-"), part)

        return F.array_join(F.transform(parts, one), "")

    split = F.split(c, r"(?U)(?<=\w)-\n(?=\w)")
    return let(words, lambda w: let(split, lambda parts: let(F.aggregate(rest(parts), start, flag)["open"], lambda open_: joined(parts, open_, w))))
