"""Text expressions: tokens, shingles, hashes, HTML to text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_LETTERS = r"[^\p{L}]+"
DIMS = 64


def words(text: str | Column) -> Column:
    """Lower-cased runs of letters."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), NOT_LETTERS), lambda w: w != "")


def hash_number(text: Column, digits: int = 8) -> Column:
    """Portable number from the leading hex digits of md5."""
    return F.conv(F.left(F.md5(text), F.lit(digits)), 16, 10).cast("long")


def shingles(tokens: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` words; a shorter text is one shingle.

    ``tokens`` must be a column: an expression would be computed again for every run.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
                       lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.array_distinct(F.when(F.size(tokens) >= n, runs).otherwise(
        F.array(F.array_join(tokens, " "))))


def count_in(tokens: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(lexicon)))


# HTML entities decoded in text, ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&amp;", "&")]


def html_to_text(html: str | Column) -> Column:
    """Drop scripts, styles, comments and tags, decode common entities, collapse white space."""
    out = F.col(html) if isinstance(html, str) else html
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->",
                    r"(?s)<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def basename(path: str | Column) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(name: str | Column) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
