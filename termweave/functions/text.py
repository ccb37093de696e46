"""Text and identifier expressions, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, sentence break and inline OBO identifiers.
WHITE_SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
SENTENCE_BREAK = rf"(?<=[.!?]){WHITE_SPACE}+(?=[A-Z])"
OBO_ID = r"\([A-Z]+:\d+\)"
EMPTY_PARENTHESES = r"\(\)"
DOI_ROOT = "https://doi.org/"


def strip(col: Column) -> Column:
    """Remove white space (tabs, newlines and Unicode blanks too) at both ends."""
    return F.regexp_replace(col, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(~F.rlike(col, F.lit(f"[^{WHITE_SPACE[1:-1]}]")), F.lit(True))


def sentences(col: Column) -> Column:
    """Split at white space that follows ``. ! ?`` and precedes an ASCII capital."""
    return F.split(col, SENTENCE_BREAK)


def strip_obo_ids(col: Column) -> Column:
    """Drop inline ids such as ``(GO:0001234)`` and the empty parentheses they leave."""
    return F.regexp_replace(F.regexp_replace(col, OBO_ID, ""), EMPTY_PARENTHESES, "")


def join_sentences(values: Column) -> Column:
    """``["a.", "", "b"]`` to ``"a. b."``: one description out of an array of property values."""
    kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    text = F.array_join(F.transform(kept, lambda v: F.rtrim(v, F.lit("."))), ". ")
    return F.when(text != "", strip(F.concat(text, F.lit(".")))).otherwise(F.lit(""))


def describe(*values: Column) -> Column:
    return join_sentences(F.array(*values))


def mentions_obsolete(label: Column, description: Column) -> Column:
    """Case-sensitive in the label, case-insensitive in the description."""
    found = F.contains(label, F.lit("obsolete")), F.contains(F.lower(description), F.lit("obsolete"))
    return F.coalesce(found[0], F.lit(False)) | F.coalesce(found[1], F.lit(False))


# Elements that PubMed allows inside titles and abstracts.
INLINE_MARKUP = r"</?(?:b|i|u|sub|sup|DispFormula|(?:mml:)?(?:math|m[a-z]+))(?:\s[^<>]*)?/?>"


def strip_markup(text: Column) -> Column:
    """The text without inline elements; what stands in them stays."""
    return F.regexp_replace(text, INLINE_MARKUP, "")


def tag_text(label: Column, description: Column) -> Column:
    """Text to encode for a term: ``label - description``, or the label alone."""
    return F.when(is_blank(description), label).otherwise(F.concat_ws(" - ", label, description))


def local_name(iri: Column) -> Column:
    """Last ``/`` segment of an IRI."""
    return F.substring_index(iri, "/", -1)


def fragment(iri: Column) -> Column:
    """What follows the last ``#`` of an IRI."""
    return F.substring_index(iri, "#", -1)


def doi_url(doi: Column) -> Column:
    return F.concat(F.lit(DOI_ROOT), doi)


def doi_iri(doi: Column) -> Column:
    """DOI as an IRI: percent-encoded, with ``/`` and the unreserved characters left as they are."""
    encoded = F.url_encode(doi)
    for code, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.concat(F.lit(DOI_ROOT), encoded)


def expand_curie(curie: Column, prefixes: dict[str, str], bound: Column | None = None) -> Column:
    """``prefix:name`` to a full IRI; null for an unknown prefix; ``<iri>`` and full IRIs pass through.

    ``bound`` is a map of further prefixes, which go first.
    """
    unquoted = F.regexp_extract(curie, r"^<(.*)>$", 1)
    prefix, name = F.substring_index(curie, ":", 1), F.regexp_replace(curie, r"^[^:]*:", "")
    known = F.lit(None).cast("string")
    for key, iri in sorted(prefixes.items()):
        known = F.when(prefix == key, F.concat(F.lit(iri), name)).otherwise(known)
    if bound is not None:
        known = F.coalesce(F.concat(F.try_element_at(bound, prefix), name), known)
    return F.when(unquoted != "", unquoted).when(F.contains(curie, F.lit("://")), curie).otherwise(known)


def first_value(ids: Column, kind: str) -> Column:
    """``_VALUE`` of the first ``{_VALUE, _IdType}`` of the given kind, else null."""
    return F.get(F.filter(ids, lambda x: x["_IdType"] == kind), 0)["_VALUE"]


def any_text(parts: Sequence[Column]) -> Column:
    return F.coalesce(*parts, F.lit(""))
