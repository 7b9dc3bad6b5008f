"""String operators as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that these functions trim and split on.
BLANKS = " \t\n\r\f\x0b"
_BLANK_RUN = "[ \\t\\n\\r\\f\\x0B]+"


def strip(c: Column, chars: str = BLANKS) -> Column:
    return F.btrim(c, F.lit(chars))


def tokenize(c: Column) -> Column:
    """Lower-cased words between white space; no empty ones."""
    return F.filter(F.split(F.lower(c), _BLANK_RUN), lambda x: x != "")


def normalize_link(c: Column) -> Column:
    """A wiki link's target: no alias, anchor, folders or .md ending; trimmed and in lower case."""
    target = F.substring_index(F.substring_index(c, "|", 1), "#", 1)
    last = F.element_at(F.split(F.translate(target, "\\", "/"), "/"), -1)
    return F.lower(strip(F.regexp_replace(strip(last), "(?i)\\.md$", "")))


#: What a wiki link looks like, the characters that a slug drops, and the slug of an empty topic.
WIKI_LINK, SLUG_DROPS, EMPTY_SLUG = "\\[\\[([^\\]]+?)\\]\\]", '[\\\\/:*?"<>|]', "wiki-note"


def link_targets(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WIKI_LINK), F.lit(1))


def normalize_entity(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(strip(c)), _BLANK_RUN, " "), ".,;:!?'\"()[]{}")


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("entity::"), normalize_entity(name))


def slugify(c: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(strip(c), SLUG_DROPS, ""), _BLANK_RUN, "-")
    return F.coalesce(F.nullif(strip(kept, "-"), F.lit("")), F.lit(EMPTY_SLUG))


def header_path(*levels: Column) -> Column:
    return F.concat_ws(" > ", *(F.nullif(x, F.lit("")) for x in levels))


def unit_id(source: Column, path: Column, index: Column) -> Column:
    return F.concat_ws("::", source, path, index.cast("string"))


def unit_key(chunk_id: Column, source: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.concat_ws("::", source, path))


def preview(c: Column, size: int = 200) -> Column:
    return F.regexp_replace(F.substring(c, 1, size), "\n", " ")


def normalize_path(c: Column) -> Column:
    return F.regexp_replace(F.translate(strip(c), "\\", "/"), "^/+", "")


def is_public(c: Column) -> Column:
    """Deny by default: only a true value or the word true is public."""
    return F.coalesce(F.lower(strip(c.cast("string"))) == "true", F.lit(False))


def link_list(raw: Column) -> Column:
    """Names between commas or line ends, trimmed and in lower case."""
    return F.filter(F.transform(F.split(F.translate(raw, "\n", ","), ","), lambda x: F.lower(strip(x))), lambda x: x != "")


def first_json_array(c: Column) -> Column:
    return F.from_json(F.regexp_extract(c, "(?s)\\[.*?\\]", 0), "array<string>")


def display_label(kind: Column, source: Column, community: Column) -> Column:
    return F.when(kind == "community_summary", F.concat(F.lit("community "), F.coalesce(community.cast("string"), F.lit("?")))).otherwise(source)


def is_marker(text: Column, marker: str) -> Column:
    return strip(text).startswith(marker)


def compose_note(topic: Column, body: Column, links: Column, date: Column) -> Column:
    """A note: frontmatter (with the date, if any), title, body, related links, one line end."""
    head = F.concat(F.lit("---\n"), F.coalesce(F.concat(F.lit("date: "), date, F.lit("\n")), F.lit("")), F.lit("type: wiki\npublic: false\n---\n"))
    related = F.when(F.size(links) > 0, F.concat(F.lit("\n\n## Related\n"), F.array_join(F.transform(links, lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n"))).otherwise("")
    return F.concat(head, F.lit("# "), topic, F.lit("\n\n"), strip(body), related, F.lit("\n"))
