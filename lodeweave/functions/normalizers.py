"""Label normalizers as Column expressions. They differ on purpose and are not interchangeable."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Letters with marks and their base letters, derived from Unicode (one letter to one letter)."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_table()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}+", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_camel(c: Column) -> Column:
    """A space before a capitalised word and between a small letter or digit and a capital."""
    return F.regexp_replace(F.regexp_replace(c, r"(.)([A-Z][a-z]+)", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")


def _words_only(c: Column) -> Column:
    c = F.translate(F.regexp_replace(c, r"[_/\\:;|]+", " "), "-", " ")
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "))


def _straight(c: Column) -> Column:
    return F.translate(c, "“”’—–", "\"\"'  ")


def evaluation(c: Column, camel: bool = True) -> Column:
    """Quotes straightened, camel case split, accents and punctuation dropped, lower case; null gives ''."""
    c = _straight(F.coalesce(c, F.lit("")))
    return _words_only(F.lower(strip_accents(split_camel(c) if camel else c)))


def domain(c: Column) -> Column:
    """Like N1 without camel splitting and with accents kept."""
    return _words_only(F.lower(_straight(F.coalesce(c, F.lit("")))))


def consolidation(c: Column) -> Column:
    """Letters a-z and digits of the text without accents, single spaces."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"[^a-z0-9]+", " "))


def grouping(c: Column) -> Column:
    """Lower case, single spaces, everything but word characters, spaces and hyphens deleted."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"\s+", " "), r"[^\p{L}\p{N}_\s\-]", "")


def compatibility(c: Column) -> Column:
    """Hint prefixes joined, then only a-z and digits."""
    t = F.lower(F.coalesce(c, F.lit("")))
    for prefix in ("semantic_role:", "candidate_family:", "domain:", "range:"):
        t = F.replace(t, F.lit(prefix), F.lit(prefix.rstrip(":").replace("_", "")))
    return F.regexp_replace(t, r"[^a-z0-9]+", "")


def spacing(c: Column) -> Column:
    """Lower case and single spaces."""
    return squeeze(F.lower(c))


def grounding(c: Column) -> Column:
    """Lower case without accents; listed punctuation becomes a space."""
    t = F.translate(F.lower(strip_accents(F.coalesce(c, F.lit("")))), "’`", "''")
    return squeeze(F.regexp_replace(t, r"[_\-–—/;:,.()\[\]{}]+", " "))


def plain(c: Column) -> Column:
    """Lower case, trimmed."""
    return F.trim(F.lower(c))


def benchmark(c: Column) -> Column:
    """Lower case, trimmed, underscores and hyphens as spaces."""
    return F.translate(F.trim(F.lower(c)), "_-", "  ")


def schema_label(c: Column) -> Column:
    """Separators and camel case split, then only a-z and digits with single spaces."""
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[_\-]+", " ")
    t = F.lower(F.regexp_replace(t, r"(?<=[a-z])(?=[A-Z])", " "))
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def schema_compact(c: Column) -> Column:
    """N10 without spaces."""
    return F.replace(schema_label(c), F.lit(" "), F.lit(""))


def ontology_label(c: Column) -> Column:
    """N11: '' for nan/none/null; camel case split; word characters and <>.,:+# kept."""
    t = F.trim(F.coalesce(c, F.lit("")))
    s = F.translate(F.regexp_replace(t, r"(?<=[a-z])(?=[A-Z])", " "), "_-/", "   ")
    s = F.lower(squeeze(F.regexp_replace(s, r"[^\p{L}\p{N}_\s<>.,:+#]", " ")))
    return F.when(F.lower(t).isin("", "nan", "none", "null"), "").otherwise(s)


def by_alias(c: Column, aliases: dict[str, str]) -> Column:
    """A trimmed lower-case label through an alias map; unknown labels stay."""
    key = F.trim(F.lower(c))
    if not aliases:
        return key
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


#: Spellings of the five relations and their names.
RELATION_ALIASES = {
    "CAUSE": "CAUSES", "CAUSES": "CAUSES", "CAUSED_BY": "CAUSES", "TRIGGER": "TRIGGERS", "TRIGGERS": "TRIGGERS", "ACTIVATES": "TRIGGERS",
    "REQUIRE": "REQUIRES", "REQUIRES": "REQUIRES", "NEEDS": "REQUIRES", "HANDLED_BY": "HANDLED_BY", "HANDLES": "HANDLED_BY", "RESOLVED_BY": "HANDLED_BY",
    "REFERENCE": "REFERENCES", "REFERENCES": "REFERENCES", "MENTIONS": "REFERENCES",
}


def relation(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Upper case with underscores, then through the alias map."""
    t = F.translate(F.upper(strip_accents(F.trim(F.coalesce(c, F.lit(""))))), " -", "__")
    t = F.regexp_replace(F.regexp_replace(t, r"[^A-Z0-9_]+", ""), r"_+", "_")
    t = F.regexp_replace(t, r"^_|_$", "")
    table = RELATION_ALIASES if aliases is None else aliases
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, t), t)


def slug(c: Column, empty: str = "unknown") -> Column:
    """Runs of other characters as one underscore, none at the ends; ``empty`` if nothing is left."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^a-z0-9]+", "_")
    t = F.regexp_replace(t, r"^_+|_+$", "")
    return F.when(t == "", empty).otherwise(t)


def iri_part(c: Column, empty: str = "unknown") -> Column:
    """N14 for IRIs: case kept, & as 'and'."""
    t = F.regexp_replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit("and")), r"[^A-Za-z0-9]+", "_")
    t = F.regexp_replace(t, r"^_+|_+$", "")
    return F.when(t == "", empty).otherwise(t)


def compare_key(c: Column) -> Column:
    """A-z and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def line_key(c: Column) -> Column:
    """N15 for repeated lines: single spaces, runs of digits as #."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), r"[0-9]+", "#")


def docred(c: Column) -> Column:
    """Lower case, single spaces, quotes around the text dropped."""
    return F.regexp_replace(squeeze(F.lower(F.coalesce(c, F.lit("")))), r"^[\"'`]+|[\"'`]+$", "")


def profile_key(c: Column) -> Column:
    """Lower case, straight apostrophes, single spaces, no punctuation at the ends."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.trim(F.lower(c)), "’", "'"), r"\s+", " "), r"^[ .:;,]+|[ .:;,]+$", "")


def tokens(normalized: Column) -> Column:
    """The distinct words of a normalized text."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: w != ""))
