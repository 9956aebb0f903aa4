"""Text expressions: all are built-in columns that stay inside code generation or the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.vectors import bound

CHUNK_CHARS = 900
SNIPPET_CHARS = 180
UNKNOWN = "unknown"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: White space at the ends of a text and, in a pattern, anywhere.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
SPACE = r"[\s\x1c-\x1f]"


def stripped(text: Column) -> Column:
    """No white space (of any kind, not only 0x20) at the ends."""
    return F.btrim(text, F.lit(SPACES))


def normalised(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def pieces(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Fixed-size pieces of a normalised text, in one pass; empty for blank and null texts."""
    return F.regexp_extract_all(F.coalesce(normalised(text), F.lit("")), F.lit(f"(?s).{{1,{size}}}"), 0)


#: Characters whose case folding is not their lower case, as a rule of Unicode's own tables (ligatures, sharp s, long s, ...).
FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x20000)) if c.casefold() != c.lower() or c == "Σ"}


def _ranges(characters: list[str], gap: int = 16) -> str:
    """A pattern of a few ranges that hold the characters: a long list of single ones is slow to match."""
    out: list[list[int]] = []
    for i in sorted(map(ord, characters)):
        if out and i - out[-1][1] <= gap:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in out) + "]"


_FOLDABLE = _ranges([c for c in FOLDED if c != "ß"])
#: Beyond Latin-1, or the micro sign, its one foldable character beside sharp s: a test of two ranges, where _FOLDABLE has many.
_BEYOND = "[^\\x00-\\xb4\\xb6-\\xff]"
#: Those that fold to one character, and those that fold to more.
_ONE = {c: f for c, f in FOLDED.items() if len(f) == 1}
_MORE = {c: f for c, f in FOLDED.items() if len(f) > 1 and c != "ß"}
_AROUND = "(?={0})|(?<={0})".format(_ranges(list(_MORE)))


def _wide(text: Column) -> Column:
    """Any character beyond ASCII: no pattern has to be matched to know it."""
    return F.octet_length(text) != F.char_length(text)


def fold(text: Column) -> Column:
    """Full case folding; by tables only where a text holds one of FOLDED beside the common sharp s.

    A text is cut at the characters that fold to more than one, so that the table is searched for these pieces alone."""
    text = F.replace(text, F.lit("ß"), F.lit("ss"))
    table = F.create_map(*[F.lit(x) for pair in _MORE.items() for x in pair])
    parts = F.split(F.translate(text, "".join(_ONE), "".join(_ONE.values())), _AROUND)
    special = F.array_join(F.transform(parts, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.lower(F.when(_wide(text) & text.rlike(_BEYOND) & text.rlike(_FOLDABLE), special).otherwise(text))


def tokens(text: Column) -> Column:
    """Distinct folded runs of [a-z0-9_], two characters or more, and bigrams of all CJK characters."""

    def cut(folded: Column) -> Column:
        latin = F.regexp_extract_all(folded, F.lit("[a-z0-9_]{2,}"), 0)
        cjk = F.regexp_extract_all(F.regexp_replace(folded, "[^㐀-鿿]+", ""), F.lit("(?=(..))"), 1)
        return F.array_distinct(F.when(_wide(folded), F.concat(latin, cjk)).otherwise(latin))

    return bound(F.coalesce(fold(text), F.lit("")), cut)  # folded once


def token_cosine(shared: Column, n_query: Column, n_text: Column) -> Column:
    """Shared tokens over the root of both set sizes; 0 without any."""
    one = F.lit(1)
    return F.when(shared > 0, shared / F.sqrt((F.greatest(n_query, one) * F.greatest(n_text, one)).cast("double"))).otherwise(F.lit(0.0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def like_ascii(text: Column, query: str) -> Column:
    """LIKE %query%: only A-Z fold, % and _ in the query are wildcards, nothing escapes."""
    pattern = "%" + query.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%"
    return ascii_lower(text).like(pattern)


def contains_folded(text: Column, query: str) -> Column:
    """The query as a substring, both lower-cased; an empty query matches."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def any_contains(texts: Column, query: str) -> Column:
    return F.exists(texts, lambda x: contains_folded(x, query))


def direction_terms(direction: str) -> list[str]:
    """Distinct lower-cased words of a direction."""
    return sorted({t.lower() for t in direction.split()})


def matched_terms(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur as substrings."""
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(F.lower(text), F.lit(term)).cast("int")
    return total


def snippet(text: Column) -> Column:
    return F.substring(F.replace(stripped(text), F.lit("\n"), F.lit(" ")), 1, SNIPPET_CHARS)


def after_labels(text: Column, labels: list[str]) -> Column:
    """Values after the first label (in order) that has any: ``label[s]: a, b and c``; else [unknown]."""
    found = F.lit(None).cast("array<string>")
    for label in reversed(labels):
        pattern = rf"(?iU)\b{re.escape(label)}s?\s*:\s*([^.\n;]+)"
        values = F.filter(F.transform(F.split(F.regexp_extract(text, pattern, 1), ",| and "), stripped), lambda x: x != "")
        found = F.when(text.rlike(pattern), values).otherwise(found)
    return F.coalesce(found, F.array(F.lit(UNKNOWN)))


def sentences(text: Column) -> Column:
    """Trimmed sentences: split after . ! ? and their full-width forms where white space follows."""
    return F.filter(F.transform(F.split(text, f"(?U)(?<=[.!?。！？]){SPACE}+"), stripped), lambda s: s != "")


def sentences_with(text: Column, keywords: list[str], most: int = 5) -> Column:
    """The first sentences that hold any keyword, case ignored; else [unknown]."""
    def hit(s: Column) -> Column:
        found = F.lit(False)
        for k in keywords:
            found = found | F.contains(F.lower(s), F.lit(k.lower()))
        return found

    matched = F.slice(F.filter(sentences(text), hit), 1, most)
    return F.when(F.size(matched) > 0, matched).otherwise(F.array(F.lit(UNKNOWN)))


def comma_tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), stripped), lambda x: x != "")


def clean_text(value: Column) -> Column:
    return stripped(F.coalesce(value, F.lit("")))


def clean_list(values: Column) -> Column:
    """Trimmed non-blank entries; null reads as empty."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), stripped), lambda x: x != "")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def leading_year(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{4}"), F.left(text, F.lit(4)).cast("int"))


def citation_numbers(answer: Column, n_sources: Column) -> Column:
    """The linked [n] of an answer: 1 <= n <= number of sources, in order, repeats kept."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))
    return F.filter(numbers, lambda n: (n >= 1) & (n <= n_sources))


def shortened(title: Column) -> Column:
    return F.when(F.length(title) > 34, F.concat(F.substring(title, 1, 31), F.lit("..."))).otherwise(title)


def collection_slug(schema: Column, provider: Column, model: Column, dimension: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("_", provider, model)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("paper_chunks_v"), schema.cast("string"), F.lit("_"), slug, F.lit("_"), dimension.cast("string"))


def profile_key(schema: Column, provider: Column, model: Column, dimension: Column) -> Column:
    return F.concat(F.lit("v"), F.concat_ws(":", schema.cast("string"), provider, model, dimension.cast("string")))


def content_hash(doc_id: Column, page: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", doc_id, page.cast("string"), text), 256)


def migration_id(profile: Column, source: Column, target: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", profile, source, target), 256), F.lit(20))
