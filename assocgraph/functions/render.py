"""Markdown to HTML as column expressions: blocks between blank lines, and inside of them a list of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import html_escaped, percent_encoded

WIKI, BOLD = r"\[\[[^\]]*+(?:\](?!\])[^\]]*+)*+\]\]", r"\*\*[^*]*+(?:\*(?!\*)[^*]*+)*+\*\*"
ITALIC, LINK = r"\*[^*\n]+\*", r"\[[^\]\n]*\]\([^)\n]*\)"
#: What is opened but not closed: an address goes, all else stays as it is and is looked into no further.
OPEN_LINK = r"\[[^\]\n]*\]\([^)\n]*"
TOKEN = "|".join(["(?s)" + WIKI, r"\[\[.*", BOLD, r"\*\*.*", ITALIC, r"\*[^*\n]*", LINK, OPEN_LINK, r"\[[^\]\n]*\]?", r"[^\[*]+"])
#: White space around a text.
AROUND = r"^\s+|\s+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, AROUND, "")


def inner(token: Column, n: int) -> Column:
    """A token without n characters at both ends."""
    return F.substring(token, F.lit(n + 1), F.length(token) - 2 * n)


def inline(text: Column, corpus: str = "main") -> Column:
    """Escaped text with wiki links into the corpus, external links, bold and italic."""

    def token(t: Column) -> Column:
        name = inner(t, 2)
        bar = F.instr(name, "|")
        target = F.when(bar > 0, stripped(F.substring(name, F.lit(1), bar - 1))).otherwise(name)
        shown = F.when(bar > 0, stripped(F.substring(name, bar + 1, F.length(name)))).otherwise(name)
        wiki = F.concat(F.lit('<a href="/w/'), percent_encoded(F.lit(corpus)), F.lit("/"), percent_encoded(target), F.lit('">'), html_escaped(shown), F.lit("</a>"))
        label, address = F.regexp_extract(t, r"^\[([^\]]*)\]", 1), F.regexp_extract(t, r"^\[[^\]]*\]\((.*)\)$", 1)
        link = F.concat(F.lit('<a href="'), html_escaped(address), F.lit('" rel="nofollow noopener" target="_blank">'), html_escaped(label), F.lit("</a>"))
        whole = lambda pattern: t.rlike(f"(?s)^(?:{pattern})$")
        kinds = [
            (whole(WIKI), wiki),
            (t.startswith("[["), html_escaped(t)),
            (whole(BOLD), F.concat(F.lit("<strong>"), html_escaped(name), F.lit("</strong>"))),
            (t.startswith("**"), html_escaped(t)),
            (whole(ITALIC), F.concat(F.lit("<em>"), html_escaped(inner(t, 1)), F.lit("</em>"))),
            (whole(LINK), link),
            (whole(OPEN_LINK), F.concat(F.lit("["), html_escaped(label), F.lit("]"))),
        ]
        out = F.when(*kinds[0])
        for kind in kinds[1:]:
            out = out.when(*kind)
        return out.otherwise(html_escaped(t))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), token), "")


def body(text: Column, corpus: str = "main") -> Column:
    """Headings of level 2 to 6 (one `#` counts as two), lists of lines that all begin with `*`, else paragraphs."""

    def block(b: Column) -> Column:
        level = F.least(F.lit(6), F.greatest(F.lit(2), F.length(F.regexp_extract(b, r"^(#{1,6})", 1)))).cast("string")
        heading = F.concat(F.lit("<h"), level, F.lit(">"), inline(stripped(F.regexp_replace(b, r"^#{1,6}", "")), corpus), F.lit("</h"), level, F.lit(">\n"))
        lines = F.transform(F.split(b, "\n"), lambda x: F.regexp_replace(x, r"^\s+", ""))
        items = F.transform(lines, lambda x: F.concat(F.lit("  <li>"), inline(stripped(F.regexp_replace(x, r"^\*+", "")), corpus), F.lit("</li>\n")))
        bullets = F.concat(F.lit("<ul>\n"), F.array_join(items, ""), F.lit("</ul>\n"))
        paragraph = F.concat(F.lit("<p>"), inline(F.replace(b, F.lit("\n"), F.lit(" ")), corpus), F.lit("</p>\n"))
        return F.when(b.startswith("#"), heading).when(F.forall(lines, lambda x: x.startswith("*")), bullets).otherwise(paragraph)

    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), stripped), lambda b: b != "")
    return F.array_join(F.transform(blocks, block), "")
