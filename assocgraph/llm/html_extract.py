"""Main text of web pages by equivalence classes of template tokens.

A token is a tag at its path, or a whole block of text at its path of tag names. Tokens of the pages of one host that occur
equally often on every page (equal occurrence vectors) form an equivalence class; vectors are compared by a sum of page
hashes, which adds up over tasks, so no host's pages are ever brought together. A class is valid if it is on half of the
host's pages at least and holds elements (both tags, each once a page: the parser closes elements from the inside out, so
the tags pair up on every page) or texts that most distinct pages hold, three at least, each equally often; pages are
distinct if their texts are, so copies count once, and two pages that share a text are no proof of a template. A valid class
is nested in the valid class of the nearest element around its first token. The valid classes so nested are the template
(`template_classes`); what lies between their tags and texts are the slots.

Of a page's text, only the blocks of the template and noise are dropped: what is in scripts, styles, forms, menus, headers,
footers and sidebars by their tags, and in adverts, notices, comments and the like by words in the class, id or role of an
element. Words for comments and adverts always count outside of articles, all words where two pages of the host have the
same name at the same place, so a block of one article that happens to have such a name stays; on hosts of one page, which
have no template, they always count. They never count for an element that holds an article, main or h1 element (on pages
without any, `MOST` of the text): `with-sidebar` around a page is no sidebar. Nor is a tag noise that holds all that the
page has of article and main elements (a form also those of h1), like a form around the whole page. All other text is kept,
cut into blocks at block tags. The main slot of a page is the deepest element of the host's template (for a host of one page,
the deepest element) that holds all of this text.

A page's elements are numbered, and its paths hashed step by step, so work and memory are linear in the page however deep
its elements nest.

Defined results: a null or empty html has the empty text; a null url is a host of its own; broken or unclosed markup ends
where its parent does; character references are decoded, unknown ones stay; rows that repeat are extracted each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Container, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, in_arrow, pieces

#: Elements without content, elements whose content is no text, elements that start and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("nav aside footer form button select dialog menu head".split()) | RAW
#: Elements that a head can hold; any other one ends it, and so does text.
HEAD_TAGS = frozenset("head base link meta noscript script style template title".split())
#: Names of adverts, comments and cookies, and of all noise.
STRONG = r"ads?|advert\w*|sponsor\w*|cookie(?:s|bar|banner|box|consent|law|notice|popup)*|comment(?:s|list|form|area|box|section|thread|wrap|wrapper)*|replies|respond|disqus"
STRONG_NAMES = re.compile(rf"(?:^|[\s_-])(?:{STRONG})(?:$|[\s_-])", re.I)
NOISE_NAMES = re.compile(
    rf"(?:^|[\s_-])(?:{STRONG}|promo\w*|consent|gdpr|notice|notification|alert|sidebar|widget|menu|(?:top|side|main|sub|site|page|bottom)?nav(?:bar|igation|list|links)?|breadcrumbs?|share|sharing|social|related(?=$|\s|[_-](?:posts?|articles?|stories|links?|items?|content|reading|news|pages?))|newsletter|subscribe|signup|login|popup|modal|overlay|footer|toolbar|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
#: Names of noise outside of articles only.
PAGE_NAMES = re.compile(r"(?:^|[\s_-])(?:banner|side|header|masthead|topbar)(?:$|[\s_-])", re.I)
PIECE = re.compile(r"[^<]+|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>=]|=)*+)(?:>|\Z)|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*(?:>|\Z)|<", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements that end when the next one like them starts.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements around which no name means noise, and the share of the text that does instead on pages without them.
MAIN_TAGS, MOST = frozenset(["article", "main", "h1"]), 0.8
#: Share of the host's pages that a template token is on.
SUPPORT = 0.5
#: Distinct pages that a text of the template is on at least, and pages that a name of noise is on.
LEAST_PAGES, LEAST_NAMES = 3, 2
MASK = 2**64 - 1


def hashed(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode(errors="replace")) - 2**63


#: Tokens that stand for a page, and for a distinct one.
PAGE, DISTINCT = hashed(""), hashed("distinct")


def squeezed(text: str) -> str:
    return " ".join(text.split())


class Page:
    """The elements of a page, numbered from 0 (the page itself) so that parents come first, and its tokens.

    tokens: (kind, name or text, element), with kind one of open, close, text. Of each element: parent; name; label (the name
    with class, id and role); path and tags (hashes of the labels, and names, from the page down; inline elements have those
    around them); noise, by the tag of an element around it or its own; named, a hash if its label has a name of noise; strong,
    whether that is one of comments or adverts outside of articles.
    """

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, int]] = []
        self.parent, self.name, self.label, self.path, self.tags = [-1], [""], [""], [hashed("path")], [hashed("tags")]
        self.noise, self.named, self.strong = [False], [None], [False]
        self.stack, self.solid = [0], [0]  # open elements, and those of them that are not inline
        self.opened: Counter = Counter()
        at = 0
        while (m := PIECE.match(source, at)) is not None:
            at = m.end()
            name = m[2]
            if name is None:
                text = m[0]
                if text.startswith("<![CDATA["):
                    text = text[9:].removesuffix("]]>")
                elif text.startswith("<!") or text.startswith("<?"):
                    continue
                if self.name[self.stack[-1]] == "head" and text.strip():
                    self.close("head")
                self.put("text", text)
            elif m[1]:
                self.close(name.lower())
            else:
                name = name.lower()
                self.open(name, m[3] or "")
                if name in RAW and (m[3] or "").rstrip().endswith("/"):
                    self.close(name)
                elif name in RAW:
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    self.put("text", source[at : end.start() if end else len(source)])
                    at = end.end() if end else len(source)
                    self.close(name)
                if at >= len(source):
                    break
        while len(self.stack) > 1:
            self.close(self.name[self.stack[-1]])
        self.whole()

    def put(self, kind: str, what: str) -> None:
        self.tokens.append((kind, what, self.stack[-1]))

    def open(self, name: str, attributes: str) -> None:
        if self.opened["head"] and name not in HEAD_TAGS:
            self.close("head")
        nearest = self.name[self.solid[-1]]
        if nearest in CLOSES.get(name, ()) or (nearest == "p" and name in BLOCKS_END_P):
            self.close(nearest)
        up = self.stack[-1]
        names = " ".join(v.strip("\"'") for v in ATTRIBUTE.findall(attributes))
        label = f"{name}.{'.'.join(sorted(set(names.lower().split())))}" if names else name
        inside = self.opened["article"] + self.opened["main"] > 0
        inline = name in INLINE
        self.parent.append(up)
        self.name.append(name)
        self.label.append(label)
        self.path.append(self.path[up] if inline else hashed(f"{self.path[up]}/{label}"))
        self.tags.append(self.tags[up] if inline else hashed(f"{self.tags[up]}/{name}"))
        self.noise.append(name in NOISE_TAGS or (name == "header" and not inside))
        bad = names and name not in ("body", "html") and name not in MAIN_TAGS and (NOISE_NAMES.search(names) or (not inside and PAGE_NAMES.search(names)))
        self.named.append(hashed(f"name {self.tags[up]}/{label}") if bad else None)
        self.strong.append(bool(bad and not inside and STRONG_NAMES.search(names)))
        own = len(self.parent) - 1
        if name in VOID:
            self.tokens.append(("open", name, own))
            return
        self.stack.append(own)
        if not inline:
            self.solid.append(own)
        self.opened[name] += 1
        self.put("open", name)

    def close(self, name: str) -> None:
        if not self.opened[name]:
            return
        while True:
            last = self.stack[-1]
            self.put("close", self.name[last])
            self.stack.pop()
            if self.solid[-1] == last:
                self.solid.pop()
            self.opened[self.name[last]] -= 1
            if self.name[last] == name:
                return

    def whole(self) -> None:
        """Take noise from elements that hold what the page is about: their tags, then their names; and hand on what is left."""
        own, n = self.noise, len(self.name)
        inside = [False] * n  # in noise by tag
        articles, titles = [0] * n, [0] * n
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or own[i]
            articles[i], titles[i] = int(self.name[i] in ("article", "main")), int(self.name[i] == "h1")
        free = any(not inside[i] and (articles[i] or titles[i]) for i in range(1, n))
        for i in range(n - 1, 0, -1):
            articles[self.parent[i]] += articles[i]
            titles[self.parent[i]] += titles[i]
        if not free:
            for i in range(1, n):
                held = articles[i] == articles[0] > 0 or (self.name[i] == "form" and not articles[0] and titles[i] == titles[0] > 0)
                if own[i] and held and self.name[i] not in ("article", "main"):
                    own[i] = False
        for i in range(1, n):
            own[i] = own[i] or own[self.parent[i]]
        holds, size = [name in MAIN_TAGS and not bad for name, bad in zip(self.name, own)], [0] * n
        for kind, what, at in self.tokens:
            if kind == "text" and not own[at]:
                size[at] += len(what.strip())
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
            size[self.parent[i]] += size[i]
        for i, name in enumerate(self.named):
            if name is not None and (holds[i] or (not holds[0] and size[i] >= MOST * size[0] > 0)):
                self.named[i] = None


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()).split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2]


def tag_token(kind: str, path: int) -> int:
    return hashed(f"{kind} {path}")


def main_element(page: Page, blocks: list[int], allowed: Container[int] | None = None) -> str:
    """The path of the deepest element, of the allowed ones if there are such, that holds the blocks of these elements."""
    if not blocks:
        return ""
    inside = [0] * len(page.parent)
    for i in blocks:
        inside[i] += 1
    best = 0
    for i in range(len(inside) - 1, 0, -1):
        if inside[i] == len(blocks) and page.name[i] not in INLINE and (allowed is None or tag_token("open", page.path[i]) in allowed):
            best = i
            break
        inside[page.parent[i]] += inside[i]
    labels = []
    while best:
        if page.name[best] not in INLINE:
            labels.append(page.label[best])
        best = page.parent[best]
    return "".join(f"/{x}" for x in reversed(labels))


def blocks_of(page: Page, names: Container[int] | None = None) -> Iterator[tuple[int, str, bool]]:
    """Element, text and whether it is in an element with a name of noise, of each block that is no noise.

    names: the hashes of names that are noise themselves besides those of comments and adverts, all if None.
    """
    lost, within = list(page.noise), [False] * len(page.parent)
    for i, name in enumerate(page.named):
        if i:
            up = page.parent[i]
            within[i] = within[up] or name is not None
            lost[i] = lost[i] or lost[up] or (name is not None and (names is None or page.strong[i] or name in names))
    at, run = (0, False), []
    for kind, what, element in [*page.tokens, ("end", "", 0)]:
        noise = lost[element]
        if kind == "text" and not noise:
            at = at if run else (element, within[element])
            run.append(entities.unescape(what))
        elif not noise and what == "br":
            run.append(" ")
        elif noise or what not in INLINE:
            if text := squeezed("".join(run)):
                yield at[0], text, at[1]
            run.clear()


def text_token(page: Page, element: int, text: str) -> int:
    return hashed(f"text {page.tags[element]} {text}")


def stats(pages: DataFrame) -> DataFrame:
    """Per host and token: its class (sum of page hashes times occurrences), pages, uses, and for tags a hash of the element.

    For texts, `own` counts the distinct pages, and `low` and `high` are the least and most uses on one of them.
    """

    def run(batches):
        for batch in pieces(batches):
            sums: dict[tuple[str, int, int | None], list] = {}

            def add(host, token, mark, vector, n, element=None, around=None):
                got = sums.setdefault((host, token, mark), [element, 0, 0, 0, around])
                got[1] = (got[1] + vector) & MASK
                got[2] += 1
                got[3] += n

            for source, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist()):
                page, host = Page(source or ""), host_of(url)
                mark = xxhash.xxh3_64_intdigest(f"{url} {source}".encode())
                solid = Counter(page.path[i] for i in range(1, len(page.path)) if page.name[i] not in INLINE)
                ups = {page.path[i]: tag_token("open", page.path[page.parent[i]]) for i in range(1, len(page.path)) if page.name[i] not in INLINE}
                closed = Counter(page.path[i] for i in range(1, len(page.path)) if page.name[i] not in INLINE and page.name[i] not in VOID)
                for kind, counted in (("open", solid), ("close", closed)):
                    for path, n in counted.items():
                        add(host, tag_token(kind, path), None, mark * n, n, tag_token("open", path), ups[path])
                for name in {x for x in page.named if x is not None}:
                    add(host, name, None, 0, 1)
                add(host, PAGE, None, 0, 1)
                blocks = list(blocks_of(page, ()))
                own = hashed("\n".join(text for _, text, named in blocks if not named))
                found = Counter(text_token(page, element, text) for element, text, _ in blocks)
                ups = {text_token(page, element, text): tag_token("open", page.path[element]) for element, text, _ in reversed(blocks)}
                for token, n in found.items():
                    add(host, token, own, mark * n, n, None, ups[token])
                add(host, DISTINCT, own, 0, 1)
            sign = lambda v: v - 2**64 if v >= 2**63 else v
            cols = [pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int64()), pa.array([k[2] for k in sums], pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64())]
            cols += [pa.array([sign(v[j]) for v in sums.values()], pa.int64()) for j in range(1, 4)] + [pa.array([v[4] for v in sums.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["host", "token", "mark", "element", "vector", "pages", "uses", "around"])

    rows = in_arrow(pages.select("url", "html"), run, "host string, token long, mark long, element long, vector long, pages long, uses long, around long")
    # vectors add up modulo 2^64: the sum of decimals is exact, its remainder is the vector
    added = [F.max("element").alias("element"), F.max("around").alias("around"), F.sum("v").alias("v"), F.sum("pages").alias("pages"), F.sum("uses").alias("uses")]
    # copies of a page first become one row for each of its texts; the rows of tags have no mark
    once = rows.withColumn("v", F.col("vector").cast("decimal(38,0)")).groupBy("host", "token", "mark").agg(*added)
    each = F.when(F.col("mark").isNotNull(), F.col("uses") / F.col("pages"))
    summed = once.withColumn("each", each).groupBy("host", "token").agg(*added, F.count("mark").alias("own"), F.min("each").alias("low"), F.max("each").alias("high"))
    return summed.withColumn("vector", F.pmod("v", F.lit(str(2**64)).cast("decimal(38,0)"))).drop("v")


def template_classes(tokens: DataFrame) -> DataFrame:
    """host, vector, pages, elements, texts, inside: the valid equivalence classes, of tokens with one occurrence vector.

    elements and texts are hashes of the class's elements (by their opening tags) and texts; inside are the vectors of the
    valid classes whose elements are the nearest around its tokens. Hosts of one page have no class.
    """
    whole = tokens.filter((F.col("token") == PAGE) & (F.col("pages") > 1)).select("host", F.col("pages").alias("all"))
    tags = tokens.filter(F.col("element").isNotNull() & (F.col("pages") > 1) & (F.col("uses") == F.col("pages"))).join(whole, "host").filter(F.col("pages") >= F.col("all") * SUPPORT)
    pairs = tags.groupBy("host", "vector", F.col("element").alias("token")).agg(F.count("*").alias("n"), F.max("around").alias("around"), F.max("pages").alias("pages")).filter("n = 2")
    distinct = tokens.filter(F.col("token") == DISTINCT).select("host", F.col("own").alias("all"))
    shared = tokens.filter((F.col("own") >= LEAST_PAGES) & (F.col("token") != DISTINCT) & (F.col("low") == F.col("high"))).join(distinct, "host").filter(F.col("own") > F.col("all") * SUPPORT)
    members = pairs.select("host", "vector", "token", "around", "pages", F.lit(False).alias("is_text")).unionByName(shared.select("host", "vector", "token", "around", "pages", F.lit(True).alias("is_text")))
    # on half of the pages at least, so no more per host than twice a page's mean number of different tokens
    own = lambda kind: F.collect_list(F.when(kind, F.col("token")))
    around = pairs.select("host", F.col("token").alias("around"), F.col("vector").alias("outer"))
    nested = members.join(around, ["host", "around"], "left").withColumn("outer", F.when(F.col("outer") != F.col("vector"), F.col("outer")))
    return nested.groupBy("host", "vector").agg(F.max("pages").alias("pages"), own(~F.col("is_text")).alias("elements"), own(F.col("is_text")).alias("texts"), F.collect_set("outer").alias("inside"))


def template(tokens: DataFrame) -> DataFrame:
    """host, elements, names, texts: hashes of the elements and texts of the host's valid classes, and of its names of noise."""
    whole = tokens.filter((F.col("token") == PAGE) & (F.col("pages") > 1)).select("host", F.col("pages").alias("all"))
    found = template_classes(tokens).groupBy("host").agg(F.flatten(F.collect_list("elements")).alias("elements"), F.flatten(F.collect_list("texts")).alias("texts"))
    named = tokens.filter((F.col("own") == 0) & F.col("element").isNull() & (F.col("pages") > 1) & (F.col("token") != PAGE)).join(whole, "host")
    names = named.filter(F.col("pages") >= LEAST_NAMES).groupBy("host").agg(F.collect_list("token").alias("names"))
    rows = whole.select("host").join(found, "host", "left").join(names, "host", "left")
    return rows.select("host", *[F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("elements", "names", "texts")])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, blocks (array), slot (path of the main element) of each page."""
    tables = Tables(pages.sparkSession)
    # written once: the template needs them more than once, and they are much smaller than the pages
    found = tables.write("template", template(tables.write("tokens", stats(pages))))
    tables.drop("tokens")

    def run(batches):
        for batch in pieces(batches):
            out: list[list] = [[], [], []]
            columns = [batch.column(c).to_pylist() for c in ("html", "elements", "names", "texts")]
            for source, elements, names, texts in zip(*columns):
                page, shared = Page(source or ""), frozenset(texts or ())
                # null on hosts of one page: all named elements are noise, and all elements may be the slot
                names, elements = names if names is None else frozenset(names), elements if elements is None else frozenset(elements)
                kept = [(element, text) for element, text, _ in blocks_of(page, names) if not shared or text_token(page, element, text) not in shared]
                blocks, main = [text for _, text in kept], main_element(page, [element for element, _ in kept], elements)
                for values, v in zip(out, ("\n".join(blocks), blocks, main)):
                    values.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.string())], ["page_id", "url", "text", "blocks", "slot"])

    kind = pages.schema["page_id"].dataType.simpleString()
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.regexp_extract(F.lower(F.trim(F.coalesce("url", F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#]*@)?([^/?#]*)", 1)
    n = found.agg(F.coalesce(F.sum(F.size("elements") + F.size("names") + F.size("texts") + 8), F.lit(0))).first()[0]
    side = F.broadcast(found) if n <= 1_000_000 else found  # a checked size: hosts and hashes
    joined = own.withColumn("host", host).join(side, "host", "left").select("page_id", "url", "html", "elements", "names", "texts")
    return in_arrow(joined, run, f"page_id {kind}, url string, text string, blocks array<string>, slot string")


def texts(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "slot")
