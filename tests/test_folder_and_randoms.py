"""Pages written as files and read back, failures included; random numbers against the generator one by one."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from assocgraph.operators import randoms
from assocgraph.sources import corpus
from assocgraph.sources import markdown
from assocgraph.sources.markdown import MarkdownFolder

PAGES = [("index.md", "# I\n\n[[a/x]]", "title: I\n"), ("a/x.md", "é \U0001f600", None), ("a/b/y z.md", "", "title: y\n"), ("a/x+1%.md", "plus", "m")]
SCHEMA = "path string, body string, meta string"


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_pages_are_written_and_read_back(spark, tmp_path):
    spark.dataSource.register(MarkdownFolder)
    root = str(tmp_path / "wiki")
    spark.createDataFrame(PAGES, SCHEMA).repartition(3).write.format("markdown").mode("append").save(root)
    assert files(root) == sorted([p for p, _, _ in PAGES] + [p[:-3] + ".meta" for p, _, m in PAGES if m is not None])
    assert sorted(map(tuple, spark.read.format("markdown").load(root).collect())) == sorted(PAGES)
    assert {(r.path, r.body) for r in corpus.scan(spark, root).collect()} == {(p, b) for p, b, _ in PAGES if b}
    assert {r.meta for r in corpus.read_meta(spark, root).collect()} == {"title: I\n", "title: y\n", "m"}
    spark.createDataFrame([("index.md", "new", "n")], SCHEMA).write.format("markdown").mode("append").save(root)
    assert {r.path: r.body for r in spark.read.format("markdown").load(root).collect()}["index.md"] == "new"
    spark.createDataFrame([], SCHEMA).write.format("markdown").mode("append").save(root)
    assert len(files(root)) == 7


@pytest.mark.parametrize("bad", ["../out.md", "/abs.md", "a//b.md", "", "note.txt", ".state/x.md"])
def test_a_task_that_fails_leaves_no_file(spark, tmp_path, bad):
    spark.dataSource.register(MarkdownFolder)
    root = str(tmp_path / "wiki")
    rows = [(f"p{i}.md", "x", "y") for i in range(20)] + [(bad, "x", "y")]
    with pytest.raises(Exception, match="not the path of a page|PYTHON_DATA_SOURCE|aborted"):
        spark.createDataFrame(rows, SCHEMA).repartition(4).write.format("markdown").mode("append").save(root)
    # tasks that were still at work when the job was given up may leave parts of the hidden folder
    assert not os.path.exists(root) or all(f.startswith(".staging") for f in files(root))
    assert not os.path.exists(root) or spark.read.format("markdown").load(root).count() == 0
    assert not os.path.exists(tmp_path / "out.md")


def one_by_one(seed, n):
    state, out = seed or 1, []
    for _ in range(n):
        state ^= state << 13 & (1 << 64) - 1
        state ^= state >> 7
        state ^= state << 17 & (1 << 64) - 1
        out.append(state)
    return out


def test_random_numbers_at_any_offset(spark, monkeypatch):
    for seed in (0, 1, 0xC0FFEE, 2**64 - 1):
        want = one_by_one(seed, 700)
        for first, n in ((0, 700), (1, 1), (127, 130), (699, 1), (300, 256)):
            assert randoms.stretch(seed, first, n).tolist() == want[first : first + n]
    far = randoms.stretch(7, 10**15, 3)
    assert randoms.jump(np.array([7], np.uint64), np.array([10**15 + 2]))[0] != far[2] and randoms.step(randoms.jump(np.array([7], np.uint64), np.array([10**15 + 2])))[0] == far[2]
    monkeypatch.setattr(randoms, "SLICE", 100)
    rows = randoms.draws(spark, 5, 650).select("i", "value", randoms.below("value", 1000).alias("m")).collect()
    want = one_by_one(5, 650)
    assert sorted((r.i, r.value % 2**64, r.m) for r in rows) == [(i, v, v % 1000) for i, v in enumerate(want)]


def test_planted_chains(spark, monkeypatch):
    monkeypatch.setattr(randoms, "SLICE", 64)
    got = {r.node: (r.cluster, r.next) for r in randoms.planted(spark.range(400).select(F.col("id").alias("node")), 3, 5, 400).collect()}
    cluster = [v % 5 for v in one_by_one(3, 400)]
    assert got == {i: (c, next((j for j in range(i + 1, 400) if cluster[j] == c), None)) for i, c in enumerate(cluster)}


def test_the_driver_keeps_little_of_a_folder(tmp_path, monkeypatch):
    """What is planned takes a few bytes a page, however long the paths; pages are moved a few at a time; all of them come."""
    import pickle

    monkeypatch.setattr(markdown, "WAITING", 7)
    root = str(tmp_path / ("long-" * 10) / "wiki")
    writer = markdown.Writer(root)
    names = [f"shelf-{i % 3}/deep/Doc-{i}.md" for i in range(2500)] + [f"one-{i}/x.md" for i in range(20)] + ["top.md"]
    Page = type("Page", (), {})
    pages = []
    for name in names:
        page = Page()
        page.path, page.body, page.meta = name, f"# {name}", None if name == "top.md" else "m"
        pages.append(page)
    at_once = []
    own = markdown.ThreadPoolExecutor.map
    monkeypatch.setattr(markdown.ThreadPoolExecutor, "map", lambda self, f, some: at_once.append(len(some)) or own(self, f, some))
    writer.commit([writer.write(iter(pages[:1000])), None, writer.write(iter(pages[1000:]))])
    assert max(at_once) == 7 and sum(at_once) == 2 * len(names) - 1
    os.makedirs(f"{root}/.hidden/a")
    for extra in (".hidden/a/x.md", "one-1/.y.md", "one-1/note.txt"):
        open(f"{root}/{extra}", "w").close()
    reader = markdown.Reader(root)
    planned = reader.partitions()
    assert len(planned) == -(-len(names) // markdown.FILES)
    assert sum(len(pickle.dumps(p)) for p in planned) < 16 * len(names)
    found = [row for p in planned for row in reader.read(p)]
    assert sorted(found, key=str) == sorted(((n, f"# {n}", None if n == "top.md" else "m") for n in names), key=str)
