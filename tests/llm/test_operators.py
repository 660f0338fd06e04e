"""The text operators against brute force, exact round trips and held-out accuracy, with the odd rows of every table."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assocgraph.llm import bpe, chat, common, components, exact_dedup, fingerprints, fm_index, html_extract, langid, near_dedup, packing, shingles, substring_dedup, toxicity
from assocgraph.llm.common import WORD
from assocgraph.llm.shingles import word_blocks

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (None, "null id"), (5, "twice twice"), (5, "twice twice"), (6, "é ü ß \U0001f600" * 3), (7, "z" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).withColumn("did", F.lit(1)).withColumn("h", F.lit("clash")).withColumn("key", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- op1


def test_bpe_equals_library(spark, docs, odd, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_vocabulary()
    own = tokenizers.Tokenizer.from_file(path)
    more = spark.createDataFrame([(1000, "a<|endoftext|>b \x1c\x85 c'll  \n\n d"), (1001, "  lead\r\n\ttab 123 ½ ٣")], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more).unionByName(odd.select("doc_id", "text"))
    got = bpe.decode(bpe.encode(table, path), path).collect()
    want = Counter()
    for r in table.collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, np.array(ids, "<u4").tobytes(), own.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.text) for r in got) == want
    assert bpe.digests(bpe.decode(bpe.encode(empty, path), path)).count() == 0


def test_bpe_skips_stale_merges():
    codec = bpe.codec(bpe.default_vocabulary())
    for text in ("aaaaaaaaaaaaaaaa", "abababababab", "mississippi" * 9):
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert codec.decode(np.array(ids, "<u4").tobytes()) == text


# ---- op2


def page(body, nav="home", foot="f"):
    return f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li>{nav}</li></ul></nav><div class='cookie-notice'>We use cookies</div><div id='content'>{body}</div><aside>side {nav}</aside><div class='comments'><p>first!</p></div><form><p>mail</p></form><footer>{foot}</footer></body></html>"


def test_html_extract(spark):
    rows = [(i, f"http://h.org/{i}", page(f"<h1>Title {i}</h1><p>Some  text\n{i} with <b>bold</b>&nbsp;&amp;amp; words that go on</p><p>Second {i} block of text<br>and more</p>", f"nav {i}")) for i in range(5)]
    rows += [(10, None, None), (11, "http://alone.org/", page("<p>Alone &eacute; here with words enough</p>")), (12, "http://h.org/x", ""), (13, "http://h.org/y", "plain < text"), (14, "http://z.org", "<article><p>cut off in the mid"), (14, "http://z.org", "<article><p>cut off in the mid")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): r for r in html_extract.texts(table).collect()}
    for i in range(5):
        assert got[i, f"http://h.org/{i}"].text == f"Title {i}\nSome text {i} with bold &amp; words that go on\nSecond {i} block of text and more"
    assert got[10, None].text == "" and got[10, None].n_chars == 0 and got[12, "http://h.org/x"].text == ""
    assert got[11, "http://alone.org/"].text == "Alone é here with words enough"
    assert got[13, "http://h.org/y"].text == "plain < text" and got[14, "http://z.org"].text == "cut off in the mid"
    assert html_extract.texts(table).count() == len(rows) and html_extract.texts(table.limit(0)).count() == 0


def test_html_extract_finds_articles(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in table.collect()}
    for r in html_extract.texts(table).collect():
        article = source[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [html_extract.squeezed(html_extract.entities.unescape(re.sub(r"</?(b|br)>", "", x))) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_html_extract_drops_shared_texts(spark):
    def body(*blocks):
        return "<html><body><div class='c1'><div class='c2'>" + "".join(f"<p>{b}</p>" for b in blocks) + "</div></div></body></html>"

    rows = [(i, f"http://n.org/{i}", body(f"First words of page {i}", "This <i>notice</i> stands on every page &amp; says nothing", f"Last words of page {i}", *["Seen on two pages"] * (i < 2))) for i in range(5)]
    # copies are one page, two pages are no template, and neither are two near copies out of three pages
    rows += [(10 + i, f"http://copies.org/{i}", body("All of this", "is repeated")) for i in range(4)]
    rows += [(20 + i, f"http://near.org/{i}", body("Shared by two", f"but not {i}") if i else body("Another page")) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == "\n".join([f"First words of page {i}", f"Last words of page {i}", *["Seen on two pages"] * (i < 2)])
    assert all(got[10 + i] == "All of this\nis repeated" for i in range(4))
    assert [got[20 + i] for i in range(3)] == ["Another page", "Shared by two\nbut not 1", "Shared by two\nbut not 2"]


def test_html_extract_keeps_split_text(spark):
    def body(i, more=""):
        return f"<html><body><nav>menu</nav><div class='content'><h1>Heading {i}</h1><div class='lead'>Lead of page {i}</div><div class='body'>{f'Long text {i}. ' * 9}<p>and more</p>{more}</div></div><div class='second'>Another section {i}, {f'not short {i} ' * 5}</div><div class='ad'>Buy {i}</div></body></html>"

    def text(i, *more):
        return "\n".join([f"Heading {i}", f"Lead of page {i}", f"Long text {i}. " * 9, "and more", *more, f"Another section {i}, {f'not short {i} ' * 5}"]).replace(" \n", "\n").strip()

    # a name of noise on one page of a host is a block of its article, on all pages it is noise, and on a host of one page, too
    rows = [(i, f"http://two.org/{i}", body(i, "<div class='notice'>Notice of appeal</div>" * (i == 1))) for i in range(2)] + [(5, "http://one.org", body(5, "<div class='notice'>Notice</div>"))]
    got = {r.page_id: r for r in html_extract.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].text for i in (0, 1, 5)] == [text(0), text(1, "Notice of appeal"), text(5)]
    assert got[1].slot == "/html/body"


def test_html_extract_keeps_what_names_do_not_mean(spark):
    """Attributes with apostrophes, names of noise around whole pages or in headings, on hosts of one page and of several."""
    def body(i):
        return f"<html><body class='page with-sidebar'><div class='content-sidebar-wrap'><article><div class='article-header'><h2>Title {i}</h2></div><p data-x=it's class=lead>first it's words {i}</p><section id='related-work'><p>Related {i}</p></section><div class='related'>More {i}</div></article><div class='sidebar'>Side {i}</div></div><div class='header'>Head {i}</div></body></html>"

    rows = [(i, f"http://w.org/{i}", body(i)) for i in range(4)] + [(9, "http://single.org", body(9))]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in (0, 1, 2, 3, 9):
        assert got[i].blocks == [f"Title {i}", f"first it's words {i}", f"Related {i}"]
        assert got[i].slot.endswith("/article")


def test_html_extract_without_articles_drops_names_and_templates(spark):
    """Plain divs only: what every page of the host shares goes, what differs stays, however the blocks are called."""
    def body(i):
        return f"<html><body><div class='top'>The Site</div><div class='x1'><div class='x2'><p>Story {i} begins</p><p>Read all our stories</p><p>Story {i} ends</p></div></div><div class='x3'>Printed in the city</div><div class='comments'><p>Reader {i} says</p></div></body></html>"

    rows = [(i, f"http://plain.org/{i}", body(i)) for i in range(5)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.texts(table).collect()} == {i: f"Story {i} begins\nStory {i} ends" for i in range(5)}


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_extract.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_extract_finds_what_a_page_is_about(spark):
    """Heads without an end, forms and other noise around the article, elements that close themselves."""
    pages = {
        "<html><head><title>x</title><body><article><p>hello world</p></article></body></html>": "hello world",
        "<head><title>x</title><meta charset=u><link href=y><p>first<p>second": "first\nsecond",
        "<head><script>no</script>bare text<p>more": "bare text\nmore",
        "<head><title>t</title></head><body><header><h1>Site</h1></header><p>text</p>": "text",
        "<body><form id='aspnetForm'><nav>menu</nav><article><h1>T</h1><p>in a form</p><form><p>mail</p></form></article></form></body>": "T\nin a form",
        "<body><form><div><h1>Title</h1><p>words</p></div><select><option>a</select></form></body>": "Title\nwords",
        "<body><form><p>Your mail</p></form><p>text</p></body>": "text",
        "<body><aside><main><p>all there is</p></main></aside></body>": "all there is",
        "<body><article><p>one</p></article><aside><article><p>teaser</p></article></aside></body>": "one",
        "<article><p>a</p><svg viewBox='0 0'/><p>b</p><script src='x'/><p>c</p><svg><path d='x'/></svg><p>d</p></article>": "a\nb\nc\nd",
        "<main><p>text</p></main><ul class='topnav'><li>x</ul><ol class=commentlist><li>first!</ol><div id=cookiebar>ok</div><div class='ad-box'>buy</div>": "text",
        "<main><p>text</p><div class='commentary'>kept</div></main>": "text\nkept",
    }
    rows = [(i, f"http://h{i}.org/", source) for i, source in enumerate(pages)]
    assert extracted(spark, rows) == dict(enumerate(pages.values()))


def test_html_extract_drops_comments_of_a_few_pages(spark):
    def body(i):
        parts = ["<div class='comments'><p>Reader</p></div>"] * (i < 3) + ["<div class='advert'>Buy</div>"] * (4 <= i < 8) + ["<div class='notice'>Closed on Monday</div>"] * (i in (2, 9)) + ["<div class='alert'>Only here</div>"] * (i == 5)
        return f"<html><body><article><h1>T {i}</h1><p>Words {i}</p></article>{''.join(parts)}</body></html>"

    got = extracted(spark, [(i, f"http://few.org/{i}", body(i)) for i in range(10)])
    assert got == {i: f"T {i}\nWords {i}" + "\nOnly here" * (i == 5) for i in range(10)}


def test_html_template_against_brute_force(spark):
    """Classes of tokens with equal occurrence vectors, counted page by page, and the classes around them."""
    rng = random.Random(4)
    rows = []
    for i in range(9):
        extra = "".join(f"<div class='k{k}'><p>Same {k}</p><i>own {i}</i></div>" for k in range(4) if rng.random() < 0.7)
        rows.append((i, "http://b.org/x", f"<html><body><div class='m'>{extra}<p>Page {i}</p><ul>{'<li>z</li>' * rng.randint(0, 2)}</ul></div></body></html>"))
    pages = [html_extract.Page(h) for _, _, h in rows]
    vectors, kinds = {}, {}
    for k, page in enumerate(pages):
        for i in range(1, len(page.path)):
            if page.name[i] not in html_extract.INLINE:
                token = html_extract.tag_token("open", page.path[i])
                vectors.setdefault(token, [0] * 9)[k] += 1
                kinds[token] = "tag", html_extract.tag_token("open", page.path[page.parent[i]])
        for element, text, _ in html_extract.blocks_of(page, ()):
            token = html_extract.text_token(page, element, text)
            vectors.setdefault(token, [0] * 9)[k] += 1
            kinds.setdefault(token, ("text", html_extract.tag_token("open", page.path[element])))
    want = {}
    for token, vector in vectors.items():
        on, kind = [n for n in vector if n], kinds[token][0]
        if (kind == "tag" and len(on) > 1 and 2 * len(on) >= 9 and max(on) == 1) or (kind == "text" and len(on) >= 3 and 2 * len(on) > 9 and max(on) == min(on)):
            want.setdefault(tuple(vector), []).append(token)
    home = {t: v for v, ts in want.items() for t in ts if kinds[t][0] == "tag"}
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.template_classes(html_extract.stats(table)).collect()
    assert sorted(sorted(r.elements + r.texts) for r in got) == sorted(sorted(ts) for ts in want.values())
    of = {t: r for r in got for t in r.elements + r.texts}
    for vector, tokens in want.items():
        outer = {home[kinds[t][1]] for t in tokens if kinds[t][1] in home} - {vector}
        assert {of[want[v][0]].vector for v in outer} == set(of[tokens[0]].inside)
        assert of[tokens[0]].pages == sum(n > 0 for n in vector)


def test_html_extract_odd_pages(spark):
    """Very deep, very long and unclosed pages in linear time and memory; columns whose names clash."""
    deep = "<div class=aa>" * 100_000 + "deep text" + "</b></p>" * 50_000
    many = "<p>" + "<b>x</b> " * 50_000 + "<p>end" + "<li>item" * 20_000
    ads = "<div class=ad>" * 20_000 + "lost" + "</div>" * 20_000 + "<p>kept</p>"
    rows = [(1, "http://deep.org", deep), (2, "http://long.org", many), (3, "http://ads.org", ads), (4, "http://main.org/2", "<main>clash</main>")]
    table = spark.createDataFrame([(*r, "m", "e", [1]) for r in rows], "page_id long, url string, html string, main string, element string, names array<long>")
    got = {r.page_id: r.text for r in html_extract.texts(table).collect()}
    assert got[1] == "deep text" and got[4] == "clash" and got[3] == "kept"
    assert got[2] == "\n".join([" ".join(["x"] * 50_000), "end", *["item"] * 20_000])


# ---- op3


def weighted(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    sets = [weighted(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        both = sum((a & b).values())
        if (not a and not b) or (a and b and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both)):
            parent[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    low = {}
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            low[i] = (min(ids) if ids else None, len(group))
    return Counter((rows[i][0], *low[i]) for i in range(len(rows)))


def near_rows():
    rng, rows = random.Random(3), []
    for base in range(12):
        text = prose(rng.choice([8, 60, 200]), base).split()
        for _ in range(rng.randint(1, 9)):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append((100 + len(rows), " ".join(own)))
    return rows + [(900, "a " * 50), (901, "a " * 45), (902, "a " * 20)]


@pytest.mark.parametrize("block", [1000, 5])
def test_near_dedup_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_rows() + ODD
    got = near_dedup.classes(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == brute_classes(rows)


def test_near_dedup_odd_tables(spark, odd, empty):
    assert near_dedup.classes(empty).count() == 0
    assert near_dedup.classes(odd).count() == len(ODD)
    rows = near_rows()
    kept = near_dedup.one_of_each(frame(spark, rows))
    assert kept.count() == len({k[1] for k in brute_classes(rows)}) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_darts_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    x, y = (a, np.ones(300)), (np.concatenate([a[:250], rng.integers(0, 2**63, 50).astype(np.uint64)]), np.concatenate([np.ones(200), np.full(100, 3.0)]))
    both = 250.0
    true = both / (300 + (200 + 300) - both)
    same = np.mean([near_dedup.darts(*x, k=512) == near_dedup.darts(*y, k=512)])
    assert abs(same - true) < 0.08


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 500)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- op4


def test_chat_links_tool_calls(spark):
    calls = '{"tool_calls":[{"id":"a","name":"find","arguments":{"q":"x","n":2}},{"id":"b","function":{"name":"find","arguments":"{\\"q\\":5,\\"depends_on\\":[\\"a\\"]}"}}]}'
    loop = '{"tool_calls":[{"id":"c","name":"find","arguments":{"q":"1","depends_on":["d"]}},{"id":"d","name":"none","arguments":{"depends_on":["c"]}}]}'
    rows = [
        (1, 0, "user", "hi \"there\"\n"), (1, 1, "assistant", calls), (1, 2, "tool", '{"tool_call_id":"a","content":{"z":1,"b":[true,null]}}'), (1, 3, "tool", '{"tool_call_id":"b","content":"ok"}'), (1, 4, "tool", '{"tool_call_id":"zzz","content":1}'),
        (2, 0, "user", None), (2, 1, "assistant", loop), (2, 2, "tool", '{"tool_call_id":"c"}'), (None, 0, "user", "x"), (None, 1, "assistant", "{not json"), (3, 0, None, ""), (3, 0, None, ""), (4, None, "tool", "plain"),
    ]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, ckey string")
    schemas = chat.SCHEMAS | {"find": {"required": ("q",), "types": {"q": "string", "n": "integer"}}}
    out = chat.link(table, schemas).collect()
    got = {(r.conv_id, r.turn, r.position, r.kind): r for r in out}
    a, b = got[1, 1, 0, "call"], got[1, 1, 1, "call"]
    assert a.linked and a.valid and a.level == 0 and a.json == '{"arguments":{"n":2,"q":"x"},"id":"a","name":"find","type":"call"}'
    assert b.linked and not b.valid and b.violations == "q not string" and b.level == 2
    assert got[1, 2, 0, "result"].level == 1 and got[1, 3, 0, "result"].level == 3
    assert got[1, 2, 0, "result"].json == '{"content":{"b":[true,null],"z":1},"id":"a","type":"result"}'
    assert not got[1, 4, 0, "result"].linked and got[1, 4, 0, "result"].level == 0
    assert got[2, 1, 0, "call"].level is None and got[2, 1, 1, "call"].violations == "unknown tool" and got[2, 2, 0, "result"].level is None
    assert got[2, 0, 0, "call"].violations == "text empty" and not got[2, 0, 0, "call"].linked
    assert got[None, 0, 0, "call"].linked and got[None, 1, 0, "result"].linked
    assert len(out) == len(rows) + 2 and chat.link(table.limit(0)).count() == 0


# ---- op5, op9


def test_language_accuracy(spark, odd, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predictions(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    model = langid.fit(table)
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und"
    assert langid.predictions(empty).count() == 0 and {r.lang_pred for r in langid.identify(odd, langid.fit_local([])).collect()} == {"und"}


def test_language_letters_ties_and_rare_languages(spark):
    """Number signs are no letters; equal texts tie alike; a rare language has its share of the sample."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(9)), "aa") for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(["uno", "dos", "tres", "cuatro"]) for _ in range(9)), "bb") for i in range(6)]
    rows += [(2000, "½²①Ⅷ 12", "aa"), (2001, None, "aa"), (2002, "x", None), (2003, "same words", "aa"), (2003, "same words", "bb")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.labelled(table, rows=8).collect()
    assert len(sample) <= 8 and Counter(r.lang for r in sample) == {"aa": 4, "bb": 4}
    model = langid.fit(table)
    got = {r.doc_id: r for r in langid.identify(table, model).collect()}
    assert got[2000].lang_pred == got[2001].lang_pred == "und" and got[2000].score == 0.0
    assert all(got[i].lang_pred == y for i, t, y in rows if i < 2000)
    # of languages with the same centroid, the first in the alphabet
    tied = langid.fit_local([("one two", "zz"), ("one two", "yy")])
    assert tied.predict(["one two"])[0] == ["yy"]
    # brute force: cosines with every centroid, one text at a time
    for i, t, _ in rows[:20]:
        n = np.log1p(next(langid.blocks([t]))[1][0]) * model.idf
        near = model.centroids @ (n / np.linalg.norm(n))
        assert got[i].score == pytest.approx(near.max(), abs=1e-5) and got[i].lang_pred == model.languages[int(near.argmax())]


def test_language_counts_whole_long_texts(monkeypatch):
    text = prose(400, 1)
    whole = next(langid.blocks([text]))[1]
    monkeypatch.setattr(langid, "BLOCK_BYTES", 100)
    assert (next(langid.blocks([text]))[1] == whole).all()


def test_toxicity_accuracy(spark, odd, empty):
    """Both kinds count alike: some labels are noise, as no word of the corpus tells them apart."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.predictions(docs.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.8 and np.mean([not r.predicted for r in rows if not r.toxic]) > 0.9
    best = sorted(rows, key=lambda r: -r.score)[: int(0.4 * sum(r.toxic for r in rows))]
    assert np.mean([r.toxic for r in best]) > 0.85 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.predictions(empty, labels).count() == 0
    model = toxicity.fit(docs, labels)
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert all(r.score > 0.99 for r in toxicity.score(odd, toxicity.fit_local([("a", 1)])).collect())
    assert all(r.score < 0.01 for r in toxicity.score(odd, toxicity.fit_local([])).collect())


def brute_margin(model, text):
    """One window at a time, with compressors of its own."""
    words = [w[i : i + 64] for w in (text or "").lower().split() for i in range(0, len(w), 64)]
    size, stride = toxicity.WINDOW_WORDS, toxicity.STRIDE
    starts = [i for i in range(0, max(1, len(words)), stride) if i == 0 or i + size - stride < len(words)]  # until one reaches the end
    saved = []
    for i in starts:
        window = f" {' '.join(words[i : i + size])} ".encode()
        saved.append(len(model.compressors()[0].compress(window)) - len(model.compressors()[1].compress(window)))
    return np.mean(saved)


def test_toxicity_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for i in range(240):
        words = prose(rng.randint(1, 60), 1000 + i).split()
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["jerkwad", "nitwitted", "slimeball"]))
        rows.append((i, " ".join(words), int(bad)))
    model = toxicity.fit_local([(t, y) for _, t, y in rows])
    kinds = [[t for _, t, y in rows if y == k] for k in (0, 1)]
    # each dictionary comes from its own class: the other one's texts change nothing
    assert b"nitwitted" in model.toxic and b"nitwitted" not in model.ordinary
    assert toxicity.train(kinds[1], *toxicity.TOXIC_SHARE).count(b" jerkwad ") == 1 and toxicity.train(kinds[1][:4], 0.0, 5) == b""
    texts = [*ODD, (20, "A slimeball and nitwitted"), (21, " ".join(kinds[0])), (22, " ".join(kinds[1])), (23, "q " * 9), (24, "q " * 8)]
    frame_ = frame(spark, texts)
    want = Counter((i, round(float(brute_margin(model, t)), 6)) for i, t in texts)
    assert Counter((r.doc_id, round(r.margin, 6)) for r in toxicity.score(frame_, model).collect()) == want
    monkeypatch.setattr(toxicity, "BLOCK", 3)  # texts that are longer than a block
    assert Counter((r.doc_id, round(r.margin, 6)) for r in toxicity.score(frame_, model).collect()) == want
    kept = toxicity.keep_clean(frame_, model).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((i, t) for i, t in texts if brute_margin(model, t) < model.threshold)
    assert np.mean([(brute_margin(model, t) >= model.threshold) == bool(y) for _, t, y in rows]) > 0.95


def test_toxicity_threshold_is_the_best():
    for seed in range(30):
        rng = random.Random(seed)
        toxic = np.array([rng.random() < 0.4 for _ in range(25)] + [True, False])
        x = np.array([rng.randint(0, 8) + 3 * t for t in toxic], float)
        at, spread = toxicity.calibrate(x, toxic)
        good = lambda c: np.mean(x[toxic] >= c) + np.mean(x[~toxic] < c)
        assert spread > 0 and good(at) == pytest.approx(max(good(c) for c in np.arange(-1, 13, 0.5)))


# ---- op6


def test_exact_dedup_against_groups(spark, odd, empty):
    rows = [(i, RNG.choice(["a b", "ab", " ab\n", "abc", "a b", None, ""])) for i in range(40)] + ODD + [(8, "ab "), (8, "ab")]
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    want = Counter()
    for i, t in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", t or "")
        best = min(groups[bare])
        want[i, best[3], len(groups[bare]), i == best[3] and len(t or "") == -best[0], hashlib.sha256(bare.encode()).hexdigest()] += 1
    got = exact_dedup.exact_groups(frame(spark, rows), salts=3).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    kept = exact_dedup.unique_rows(frame(spark, rows)).collect()
    assert len(kept) == len(groups) and exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.unique_rows(odd).columns == odd.columns


def test_exact_dedup_of_heavy_texts_and_extreme_ids(spark, monkeypatch):
    """One text on most rows is dealt over salts; the largest and smallest ids stay what they are."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 10)
    monkeypatch.setattr(common, "HEAVY_KEYS", 5)
    rows = [(i, "same text" if i % 4 else f"own {i}") for i in range(200)] + [(2**63 - 1, "last"), (-(2**63), "first"), (None, "first"), (None, "alone")]
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(frame(spark, rows), salts=4).collect()}
    sha = lambda t: hashlib.sha256(t.replace(" ", "").encode()).hexdigest()
    assert all(got[i, sha(t)].keep_id == (1 if i % 4 else i) and got[i, sha(t)].group_size == (150 if i % 4 else 1) for i, t in rows[:200])
    assert got[2**63 - 1, sha("last")].kept and got[-(2**63), sha("first")].kept and not got[None, sha("first")].kept
    assert got[None, sha("first")].keep_id == -(2**63) and got[None, sha("alone")].kept and got[None, sha("alone")].keep_id is None
    twice = frame(spark, rows + rows[:9] * 3)
    kept = exact_dedup.unique_rows(twice.withColumn("_sha", F.lit(1))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept) == sorted([(False, i, t) for i, t in rows[:200] if i % 4 == 0 or i == 1] + [(False, 2**63 - 1, "last"), (False, -(2**63), "first"), (True, 0, "alone")])


# ---- op7


def padding(cells, tops):
    return sum(n * (min(t for t in tops if t >= length) - length) for length, n in cells)


def test_packing_boundaries_are_optimal():
    for seed in range(40):
        rng = random.Random(seed)
        cells = [(x, rng.randint(1, 50)) for x in rng.sample(range(60), rng.randint(1, 8))]
        k, sizes = rng.randint(1, 4), sorted(c[0] for c in cells)
        best = min(padding(cells, [*c, sizes[-1]]) for q in range(k) for c in itertools.combinations(sizes[:-1], q))
        tops = packing.boundaries(cells, k)
        assert len(tops) <= k and padding(cells, tops) == best


def test_packing_of_long_documents_is_optimal(spark):
    rng = random.Random(3)
    lengths = [rng.choice((rng.randint(1, 50), rng.randint(2049, 20_000))) for _ in range(24)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long"), 4).collect()
    sizes, cells = sorted(set(lengths)), list(Counter(lengths).items())
    best = min(padding(cells, [*c, sizes[-1]]) for q in range(4) for c in itertools.combinations(sizes[:-1], q))
    assert {r.boundary for r in rows} <= set(lengths) and sum(r.boundary - r.n_tokens for r in rows) == best


def test_packing_batches(spark, docs, odd, empty, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 7)
    rows = packing.pack_texts(docs.unionByName(odd.select(*docs.columns)), 4, 600).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) + len(ODD)
    batches, buckets = {}, {}
    for r in rows:
        assert r.boundary >= r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
        buckets.setdefault(r.bucket, set()).add(r.batch)
    for (bucket, batch), own in batches.items():
        room = max(1, 600 // max(1, own[0].boundary))
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= room
        assert len(own) == room or batch == max(buckets[bucket])
    assert all(len(WORD.findall(texts[r.doc_id])) == r.n_tokens for r in rows if r.doc_id in texts and r.doc_id not in {i for i, _ in ODD})
    assert packing.pack_texts(empty).count() == 0


# ---- op8


def test_fingerprints(spark, odd, empty):
    rows = [(i, prose(60, i).replace(" a", "\n\na", 3)) for i in range(30)] + [(40, "same"), (41, "same")]
    for per_block in (4, 1000):
        got = {r.doc_id: r for r in fingerprints.edits(frame(spark, rows), per_block).collect()}
        order = sorted(rows, reverse=True)
        for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
            assert 0 <= got[i].near_next <= 1 and (i > 30 or got[i].near_edited > 0.3 > got[i].near_next)
    assert got[40].fingerprint == got[41].fingerprint and got[41].near_next == 1.0
    assert len({r.fingerprint for r in got.values()}) == 31
    assert fingerprints.edits(empty).count() == 0 and fingerprints.edits(odd).count() == len(ODD)


def test_fingerprints_locate_edits(spark):
    """Only the changed paragraph's leaves, also when paragraphs and sections are put in, taken out or moved."""

    def located(x, y):
        a, b = (fingerprints.merkle(F.lit(t)) for t in (x, y))
        return spark.range(1).select(fingerprints.differing_leaves(a, b).alias("x"), fingerprints.differing_leaves(b, a).alias("y")).first()

    lines = [prose(20, i) for i in range(6)]  # three leaves each
    text = "\n".join(lines)
    put_in = lines[:3] + ["six words put in before all " + lines[3]] + lines[4:]
    assert (located(text, "\n".join(put_in)).x, located(text, "\n".join(put_in)).y) == ([9, 10, 11], [9, 10, 11, 12])
    assert located(text, "\n".join(lines[:2] + ["a new one"] + lines[2:])) == ([], [6])
    assert located(text, "\n".join(lines[1:])) == ([0, 1, 2], [])
    assert located(text, "\n".join(reversed(lines))) == ([], []) and located(text, text) == ([], [])
    sections = ["\n".join(lines[:2]), "\n".join(lines[2:4]), "\n".join(lines[4:])]
    last = lines[5].split()
    changed = "\n".join([lines[4], " ".join([*last[:8], "other", *last[9:]])])
    assert located("\n\n".join(sections), "\n\n".join([sections[1], sections[0], changed])) == ([16], [16])


def test_fingerprints_of_text_without_spaces(spark):
    rng = random.Random(2)
    text, other = ("".join(rng.choice("的一是在不了有和人这中大为上个国") for _ in range(4000)) for _ in range(2))
    got = {r.doc_id: r for r in fingerprints.edits(frame(spark, [(1, text), (2, other)])).collect()}
    assert 0.4 < got[1].near_edited < 0.6 and got[1].near_next == 0.0


def test_fingerprints_against_brute_force(spark):
    """Every digest of the tree anew, with other means."""
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def leaves(paragraph):
        return re.findall(r"[ \t\r\f\v]*(?:[^ \t\r\f\v\n]{1,16}[ \t\r\f\v]*){1,8}", paragraph) or [paragraph]

    texts = [t or "" for _, t in ODD] + ["a\n\nb", "a\n \t\nb\n", "\n\n\n", "x" * 300 + " y\xa0z\u3000w " * 40, prose(200, 5).replace(" b", "\n b")]
    for text, r in zip(texts, spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", fingerprints.merkle(F.col("t")).alias("f")).orderBy("i").collect()):
        sections, above = [], []
        for s in re.split(r"\n[ \t\r]*\n", text):
            paragraphs = [[digest(x) for x in leaves(p)] for p in s.split("\n")]
            above.append(digest("".join(digest("".join(p)) for p in paragraphs)))
            sections.append(f"{above[-1][:16]}=" + ",".join(f"{digest(''.join(p))[:12]}:{''.join(x[:8] for x in p)}" for p in paragraphs))
        assert r.f == digest("".join(above) + digest(text)) + "/" + "/".join(sections)


# ---- op10


def brute_strip(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    key = [2**63 - 1 if i is None else i for i, _ in rows]
    first = {}
    for k, w in zip(key, words):
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, k), k)
    out = Counter()
    for (d, _), k, w in zip(rows, key, words):
        gone = {p for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for p in range(i, i + 13)}
        out[d, " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone)] += 1
    return out


@pytest.mark.parametrize(("hot", "shard"), [(5000, 400_000), (2, 300)])
def test_substring_dedup_against_windows(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rng = random.Random(9)
    passages = [prose(n, 50 + n) for n in (13, 14, 30, 60)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 40), 1000 + i)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            parts += [" ".join(p[rng.randint(0, 3) :]), prose(rng.randint(0, 6), rng.random())]
        rows.append((rng.randint(0, 50), "\n".join(parts)))
    rows += [(70, passages[3] + " " + passages[3]), (70, passages[3]), (None, passages[2]), (71, "a " * 40), (72, "a " * 30), (73, passages[0])] + ODD
    got = substring_dedup.strip(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == brute_strip(rows)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def test_common_windows_are_cut_from_texts_once(spark, monkeypatch):
    """Segments of common anchors are stored: the rest of the plan reads texts for the other anchors only, and makes two reports."""
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    docs = frame(spark, [(i, prose(20, 1) + " " + prose(5, 100 + i)) for i in range(6)])
    own = docs.selectExpr("doc_id AS did", "xxhash64(text) AS h", "text", "doc_id AS c")
    assert substring_dedup.drops(own)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3


@pytest.mark.parametrize("grouped", [3, 200_000])
def test_common_windows_need_no_second_pass(spark, monkeypatch, grouped):
    """With common anchors the texts are cut, and so exchanged, as often as without: once."""
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    monkeypatch.setattr(substring_dedup, "GROUPED", grouped, raising=False)
    calls, cut = [], substring_dedup.segments
    monkeypatch.setattr(substring_dedup, "segments", lambda *a: calls.append(1) or cut(*a))
    passage = prose(20, 1)
    rows = [(i, passage + " " + prose(i % 7, 100 + i)) for i in (5, 3, 3, 9, 0, 0, 7)] + [(None, prose(4, 7) + " " + passage), (None, passage), (0, passage + " " + passage), (8, "a " * 40), (6, "a " * 30), (None, "a " * 20)]
    for some in (rows, [(None, t) for _, t in rows]):
        calls.clear()
        got = substring_dedup.strip(frame(spark, some)).collect()
        assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == brute_strip(some)
        assert len(calls) == 1


def test_a_common_window_goes_on_once_for_a_group(spark):
    """Of equal windows in a task those of the smallest doc_id are exchanged, the others are one decided row for each document."""
    seg = prose(14, 1)
    schema = "did long, h long, a long, starts array<int>, seg string, common boolean"
    found = spark.createDataFrame([(i, 100 + i, 1, [0, 50], seg, True) for i in (4, 2, 9, 2, 7)] + [(1, 101, 2, [3], seg, False)], schema).coalesce(1)
    got = substring_dedup.first_of_group(found).collect()
    assert [(r.part, r.did, r.starts) for r in got if not r.common] == [(2, 1, [3])]
    assert sorted((r.did, r.starts) for r in got if r.common and r.seg) == [(2, [0, 50])] * 2 + [(2, [1, 51])] * 2
    assert sorted((r.part, r.did, r.h, sorted(r.starts)) for r in got if r.seg is None) == [(i, i, 100 + i, [0, 1, 50, 51]) for i in (4, 7, 9)]


def test_words_of_the_contract():
    """Bytes are split at the white space of the contracts alone."""
    text = "a\x1cb\x85c\xa0d\u2003e  f\x0bg\x0ch\r\ni\tj "
    assert [w.decode() for _, _, _, words in word_blocks([text, "", " \n"]) for w in words] == WORD.findall(text)


def test_bounded_words(monkeypatch):
    """The same words as one by one, where they are, with equal hashes for equal words alone, also in small pieces."""
    texts = [prose(40, i) for i in range(30)] + ["", " \n", "a\x1cb\x85c\xa0d\u2003e  f\x0bg\x0ch\r\ni\tj ", " \u00e4\u00f6 \u4e2d\u6587\u4e2d\u6587 ", "x" * 300 + " y", "ab ba aa b a", "\x00 \x00\x00"]
    seen = {}
    for chars, at_once in ((500_000, 1 << 20), (50, 16)):
        monkeypatch.setattr(shingles, "BLOCK_CHARS", chars)
        monkeypatch.setattr(shingles, "AT_ONCE", at_once)
        got, n = [], 0
        for at, flat, sizes, raw, begin, end in shingles.bounded_words(texts):
            assert at == n
            n += len(sizes)
            words = [raw[x:y].decode() for x, y in zip(begin.tolist(), end.tolist())]
            for w, h in zip(words, flat.tolist()):
                assert seen.setdefault(w, h) == h
            got += [words[y - x : y] for x, y in zip(sizes.tolist(), np.cumsum(sizes).tolist())]
        assert got == [WORD.findall(t) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_substring_dedup_odd_tables(odd, empty):
    assert substring_dedup.digests(empty).count() == 0 and substring_dedup.digests(odd).count() == len(ODD)


def test_fm_index_counts():
    rng = random.Random(2)
    text = [rng.randrange(2, 9) for _ in range(300)] + [fm_index.SEPARATOR, fm_index.END]
    index = fm_index.FMIndex(np.array(text), 9, 13)
    for n in (1, 2, 3, 5):
        for _ in range(30):
            at = rng.randrange(300 - n)
            pattern = text[at : at + n]
            lo, hi = np.array([0]), np.array([index.n])
            for s in reversed(pattern):
                lo, hi = index.step(np.array([s]), lo, hi)
            assert hi[0] - lo[0] == sum(text[i : i + n] == pattern for i in range(300))


# ---- pipeline


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, "/root/testdata/sf0.01")
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = out.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "exact_dedup":
            assert len(after) == len({re.sub("[\x20\x09-\x0d]", "", t) for t in before.values()})
        if name == "near_dedup":
            low = {c for _, c, _ in brute_near(before)}
            assert set(after) == low
        if name == "substring_dedup":
            want = {d: t for d, t, _, gone in brute_strip(list(before.items())) if gone}
            assert all(after[d] == want.get(d, before[d]) for d in before) and all(r.n_chars == len(r.text) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    only = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, only, "/root/testdata/sf0.01").count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names, each stage by brute force."""
    rng, rows = random.Random(21), []
    for i in range(200):
        words = prose(rng.randint(1, 40), 3000 + i).split()
        for _ in range(3 if i % 4 == 0 else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["jerkwad", "nitwitted", "slimeball"]))
        rows.append((i, " ".join(words)))
    passage, base = prose(20, 77), prose(40, 78)
    odd = [(None, None), (None, None), (1000, None), (1001, ""), (1002, " \t\n"), (1003, "x"), (None, "null id"), (1005, "twice twice"), (1005, "twice twice"), (1006, "z" * 5000), (1007, base), (1008, base + " more"), (1009, base.replace(" ", "\n"))]
    odd += [(1010 + i, f"{prose(9, 400 + i)} {passage} {prose(9, 500 + i)}") for i in range(4)] + [(1020, prose(12_000, 9)), (1021, prose(12_000, 9) + " end"), (-5, base + " more")]
    clash = ["did", "h", "key", "row", "sha", "salt", "members", "score", "_id", "_salt", "node", "drops", "size"]
    schema = DOCS + ", " + ", ".join(f"{c} string" for c in clash)
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None, *[None if k % 2 else f"c{k}"] * len(clash)) for k, (i, t) in enumerate(rows + odd)], schema)
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(200)] + [(None, 0, None), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "packing":
            assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t in before)
            break
        assert out.columns == docs.columns
        if name == "toxicity":
            assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t in before if brute_margin(model, t) < model.threshold)
            assert len(got) < len(before) - 40
        if name == "exact_dedup":
            bare = {}
            for i, t in before:
                bare.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
            assert sorted((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in got) == sorted(min(x) for x in bare.values())
        if name == "near_dedup":
            named = set(brute_classes(before))
            assert Counter(r.doc_id for r in got if r.doc_id is not None) == Counter({c for _, c, _ in named if c is not None})
        if name == "substring_dedup":
            want = Counter()
            for (d, t, _, gone), n in brute_strip(before).items():
                whole = [x or "" for i, x in before if i == d and " ".join(WORD.findall(x or "")) == t]
                want[d, t if gone else whole[0]] += n
            assert Counter((r.doc_id, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)
        docs = spark.createDataFrame(got, docs.schema)


def brute_near(texts):
    """(doc_id, class, size) with candidates by shared 5-grams, for tables too large for all pairs."""
    rows = sorted(texts.items())
    sets, holders = [weighted(t) for _, t in rows], {}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        seen = Counter(j for g in s for j in holders.get(g, ()))
        for j in seen:
            both = sum((s & sets[j]).values())
            if both >= 0.8 * (sum(s.values()) + sum(sets[j].values()) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders.setdefault(g, []).append(i)
    size = Counter(find(i) for i in range(len(rows)))
    return [(rows[i][0], rows[find(i)][0], size[find(i)]) for i in range(len(rows))]


