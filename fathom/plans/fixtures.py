"""Small tables that queries and their SQL share."""

from __future__ import annotations

NOTES = [
    ("a/alpha.md", "alpha", "First Idea", "See [[Beta]] and [[beta|the second]] and `[[nowhere]]`.", ["gamma"], ["x", "y", "x"]),
    ("a/beta.md", "beta", "", "Back to [[alpha#top]] and [[folder/Gamma.MD ]].", [], ["x"]),
    ("b/alpha.md", "alpha", "", "The other [[alpha]], to itself [[b\\alpha.md]].", ["First Idea", " BETA "], []),
    ("b/gamma.md", "gamma", "Third", "[[first idea]] [[Third]] [[missing page]]", [], ["y", "z"]),
    ("c/delta.md", "delta", "", "No links here.", ["unknown"], ["z"]),
    ("c/lonely.md", "lonely", "", "Nothing at all.", [], []),
]
NOTE_COLUMNS = ("source", "stem", "node", "body", "related", "tags")
LINKS = ["Note", "Note|alias", "Note#part", "dir/Sub/Note.md", "dir\\Note.MD", "  UPPER case  ", "", "#only", "a|b#c", "x.md.md", "tab\tname\t"]
NAMES = ["  Ada  Lovelace ", "\"Quoted\"", "(Paren) .", "MiXed\tCase\nName", "...", "", "a.b"]
TOPICS = ["Plain topic", "a/b:c*d?", "  spaces   inside  ", "--edge--", "???", "Keep-Case", "tab\tand\nline"]
HEADERS = [("A", "B", "C"), ("A", "", "C"), ("", "", ""), ("A", "", ""), ("", "B", "")]
EXTRACTED = [
    ("n1.md", '{"entities": ["Ada", " ada ", "Engine"], "relations": [["Ada", "designed", "Engine"], ["Engine", "of", "ada."]]}'),
    ("n2.md", '{"entities": ["Engine", "Loom"], "relations": [["Loom", "inspired", "Engine"], ["x", "self", "X"], ["a", "b"]]}'),
    ("n3.md", '{"entities": []}'),
    ("n4.md", '{"relations": [["Ada", "knew", "Engine"], ["", "r", "Loom"]]}'),
]
PUBLIC = ["true", "True", " TRUE ", "false", "yes", "", None, "1"]
RAW_NOTES = [
    ("v/one.md", "---\ntype: idea\npublic: true\ndate: 2024-05-01\ntags: [a, b]\n---\n# One\n\nText with [[two]].\n"),
    ("v/two.md", "# Two\n\nNo frontmatter.\n\n## Part\n\nMore text here.\n"),
    ("v/three.md", "---\nnot: [closed\n---\nBody after bad YAML.\n"),
    ("v/four.md", "----\npublic: 'false'\nrelated: one\n---\n\nFour dashes begin this one.\n"),
    ("v/five.md", "---\nnever: closed\n\nAll of this is body.\n"),
    ("v/six.md", "---\n- a\n- list\n---\nA list is no mapping.\n"),
]


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return "[" + ", ".join(map(literal, value)) + "]::VARCHAR[]" if isinstance(value, list) else str(value)


def values(rows: list, *names: str) -> str:
    """The rows as a SQL table expression."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS fixture({', '.join(names)})"
