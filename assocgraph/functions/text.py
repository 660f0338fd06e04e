"""Column functions over text: tokens, costs, ids, links, titles, descriptions, slugs and markup."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens: anything but letters and numbers.
BREAKS = r"[^\p{IsAlphabetic}\p{N}]+"
#: Named character references that are decoded besides numeric ones, and what they stand for (fixed values).
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&sect;": "§", "&para;": "¶", "&amp;": "&"}
#: Namespaces whose wiki links are dropped (fixed values).
NAMESPACES = ("file:", "image:", "category:", "wikipedia:", "help:", "template:", "user:", "talk:", "portal:")


#: Letters whose lower case depends on what is around (sigma), is more than one character or is shorter than two bytes.
UNSTEADY = "\u0130\u03a3\u212a"


def tokens(text: Column) -> Column:
    """Lower-case tokens of more than one byte, in order, with repetitions.

    A text without the letters above gives the same tokens when it is put in lower case as a whole, which is cheaper.
    """
    own, long = F.coalesce(text, F.lit("")), lambda t: F.octet_length(t) > 1
    whole = F.filter(F.split(F.lower(own), BREAKS), long)
    return F.when(reduce(or_, (F.contains(own, F.lit(c)) for c in UNSTEADY)), F.transform(F.filter(F.split(own, BREAKS), long), F.lower)).otherwise(whole)


def token_cost(text: Column) -> Column:
    """A quarter of the bytes, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long"))


def page_id(path: Column) -> Column:
    """The path in lower case with forward slashes and without its last extension."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"\.[^./]*$", ""))


def folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/?[^/]*$", "")


def normalized_link(target: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(target)), " ", "-"), r"\\", "/"), r"^/+|/+$", "")


def links(text: Column) -> Column:
    """Targets of [[target]] and [[target|label]] outside of fenced code, normalized, each once, in order of first use."""
    open_text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", "")
    found = F.regexp_extract_all(open_text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, normalized_link), lambda t: t != ""))


def title(text: Column, fallback: Column) -> Column:
    """The first line that starts with `# ` and has more to say, else the fallback."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^[ \t]*# +(\S.*?)[ \t\r]*$", 1), F.lit("")), fallback)


def description(text: Column, cap: int = 160) -> Column:
    """The lines that are no headings, joined until twice the cap in bytes, without markup, cut at the cap with an ellipsis."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    joined = F.aggregate(lines, F.lit(""), lambda a, x: F.when(F.octet_length(a) >= 2 * cap, a).when(a == "", x).otherwise(F.concat(a, F.lit(" "), x)))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"\[\[(?:[^\]]*\|)?([^\]|]*)\]\]", "$1"), r"\*", ""), r"\s+", " "))
    return F.when(F.char_length(bare) > cap, F.concat(F.left(bare, F.lit(cap)), F.lit("…"))).otherwise(bare)


def slug(text: Column, cap: int = 80) -> Column:
    """ASCII letters and digits in lower case with single dashes, cut at the cap; `case` if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.left(dashed, F.lit(cap)), F.lit("")), F.lit("case"))


def case_page_id(short_name: Column, name: Column, cluster: Column) -> Column:
    """The slug of the short name, else of the name, else of `case-<cluster>`, and the cluster."""
    chosen = F.coalesce(F.nullif(short_name, F.lit("")), F.nullif(name, F.lit("")), F.concat(F.lit("case-"), cluster.cast("string")))
    return F.concat(slug(chosen), F.lit("-"), cluster.cast("string"))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "\u0000", ""), "/", "-"), "-+", "-"), "^[-\\s]+|[-\\s]+$", "")


def html_escaped(text: Column) -> Column:
    out = text
    for plain, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(named))
    return out


def json_escaped(text: Column) -> Column:
    """Text as it stands between the quotes of a JSON string."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit({9: "\\t", 10: "\\n", 13: "\\r"}.get(code, f"\\u{code:04x}")))
    return out


def percent_encoded(text: Column) -> Column:
    """Everything but letters, digits and `-_.~` as bytes in hexadecimal."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


#: A character reference: decimal, hexadecimal, or of the list.
REFERENCE = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|" + "|".join(k[1:-1] for k in ENTITIES if "#" not in k) + ");"


def character(code: Column) -> Column:
    """The character of a code point, null for numbers that are none."""
    valid = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(32)), 8, "0")), "UTF-32"))


def decoded(reference: Column) -> Column:
    """What a reference stands for; a number that is no character stays as it is."""
    digits = F.regexp_extract(reference, "^&#0*([0-9]{1,9});$", 1)
    hexadecimal = F.regexp_extract(reference, "^&#[xX]0*([0-9a-fA-F]{1,8});$", 1)
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair]), reference)
    code = F.when(digits != "", digits.try_cast("long")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("long"))
    return F.coalesce(named, character(code), reference)


def entities_decoded(text: Column) -> Column:
    """Decimal and hexadecimal references and the named ones of the list, in one pass, so that nothing is decoded twice."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    pieces = F.zip_with(F.split(text, REFERENCE, -1), found, lambda p, r: F.concat(p, F.coalesce(decoded(r), F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def html_to_markdown(html: Column) -> Column:
    """Text of markup: block tags become line breaks, other tags go, references are decoded, blanks are squeezed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|blockquote|pre|table|tr|center)\b[^>]*>", "\n")
    out = entities_decoded(F.regexp_replace(out, "<[^>]*>", ""))
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), " ?\\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def without_templates(text: Column) -> Column:
    """{{...}} taken out from the inside until none is left: as many passes as templates are deep, which is half of the most
    braces that are open at once."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def count(acc: Column, brace: Column) -> Column:
        now = F.greatest(F.lit(0), acc["now"] + F.when(brace == "{", 1).otherwise(-1))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    braces = F.split(F.regexp_replace(text, "[^{}]+", ""), "(?<=.)(?=.)")
    deep = F.floor(F.aggregate(braces, zero, count)["most"] / 2).cast("int")
    return F.aggregate(F.array_repeat(F.lit(0), deep), text, lambda t, _: F.regexp_replace(t, r"\{\{[^{}]*\}\}", ""))


def wikitext_prepared(text: Column) -> Column:
    """Comments, references, tables, templates and a few tags go; headings, emphasis and external links are rewritten."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<ref\b[^>]*>.*?</ref>", ""), r"(?i)<ref\b[^>]*/>", "")
    out = without_templates(F.regexp_replace(out, r"(?s)\{\|.*?\|\}", ""))
    out = F.regexp_replace(out, r"(?i)</?(?:small|big|sup|sub|code|nowiki|br|hr)\b[^>]*>", "")
    for level in (6, 5, 4, 3, 2):
        out = F.regexp_replace(out, rf"(?md)^={{{level}}}\s*(.+?)\s*={{{level}}}\s*$", f"{'#' * level} $1")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)'''(.+?)'''", "**$1**"), r"(?s)''(.+?)''", "*$1*")
    return F.regexp_replace(F.regexp_replace(out, r"\[(https?://\S+)\s+([^\]]+)\]", "[$2]($1)"), r"\[(https?://\S+)\]", "$1")


def wikitext_finished(text: Column) -> Column:
    """Without blanks at the start of lines, runs of blank lines and white space around."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?md)^[ \t]+", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def wikitext_to_markdown(text: Column) -> Column:
    """A text by itself: wiki links stay as they are (`etl.wikitext_pages` rewrites them among the pages of a corpus)."""
    return wikitext_finished(wikitext_prepared(text))


#: A wiki link with what is between its brackets.
WIKILINK = r"\[\[([^\[\]]+?)\]\]"


def link_slug(target: Column) -> Column:
    """The normalized title that a wiki link names: its target without the fragment."""
    return normalized_link(F.substring_index(target, "#", 1))


def dropped_namespace(target: Column) -> Column:
    low, out = F.lower(target), F.lit(False)
    for name in NAMESPACES:
        out = out | low.startswith(name)
    return out


def kept_wikilink(target: Column) -> Column:
    """The normalized target of a wiki link without its fragment; null for the dropped namespaces and bare fragments."""
    return F.when(~dropped_namespace(F.trim(target)), F.nullif(link_slug(target), F.lit("")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, 0 if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))
