"""The patterns by which the queries' SQL spells the conversion of HTML, in DuckDB's dialect; the engine has its own in functions.html."""

from __future__ import annotations

#: Entities that the tables hold, the ampersand last.
ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&")]

DROPPED = ["script", "style", "noscript", "svg", "nav", "footer", "form"]
_GONE = [(r"(?s)<!--.*?-->", "")] + [(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "") for t in DROPPED]
#: The content is the first <main>, else the <body>; up to its end or the text's.
_CONTENT = [(r"(?is)^.*?<main\b[^>]*>(.*?)</main\s*>.*$", "$1"), (r"(?is)^.*?<body\b[^>]*>", ""), (r"(?is)</body\s*>.*$", "")]
_DECODE = [(e, c) for e, c in ENTITIES]

TEXT = _GONE + _CONTENT + [
    (r"(?i)<(?:/p|/div|/h[1-6]|/li|/ul|/ol|/tr|/table|/article|/section|br)\b[^>]*>", "\n"),
    (r"(?s)<[^>]*>", ""),
    *_DECODE,
    (r"[ \t\r]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n+", "\n"),
    (r"^\s+", ""),
    (r"\s+$", ""),
]

MARKDOWN = _GONE + _CONTENT + [
    (r"\s+", " "),
    *[(rf"(?i)\s*<h{n}\b[^>]*>\s*(.*?)\s*</h{n}\s*>\s*", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)],
    (r"(?i)<a\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a\s*>", "[$2]($1)"),
    (r"(?i)<img\b[^>]*>", ""),
    (r"(?i)</?(?:b|strong)\b[^>]*>", "**"),
    (r"(?i)</?(?:i|em)\b[^>]*>", "*"),
    (r"(?i)\s*<li\b[^>]*>\s*", "\n* "),
    (r"(?i)\s*<br\b[^>]*>\s*", "  \n"),
    (r"(?i)\s*</?(?:p|div|ul|ol|table|tr|article|section|aside|header|main|blockquote)\b[^>]*>\s*", "\n\n"),
    (r"<[^>]*>", ""),
    *_DECODE,
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"\n{3,}", "\n\n"),
    (r"^\s+", ""),
    (r"\s+$", ""),
]


def sql(c: str, steps: list[tuple[str, str]]) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, to in steps:
        if pattern.startswith("&"):
            c = f"replace({c}, {q(pattern)}, {q(to)})"
        else:
            c = f"regexp_replace({c}, {q(pattern)}, {q(to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return c
