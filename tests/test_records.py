"""Records with separators inside, from files that are split at any byte, against readers that take a file whole."""

import bz2
import json
import random

import pytest

from assocgraph.sources import bulk, records


def by_hand(text):
    """Records of a CSV text: a quote at the beginning of a field opens it, the next one without a backslash closes it."""
    out, now, quoted, begins, i = [], "", False, True, 0
    while i < len(text):
        c = text[i]
        if quoted and c == "\\" and i + 1 < len(text):
            now, i = now + text[i : i + 2], i + 2
            continue
        if c == '"' and quoted:
            quoted = False
        elif c == '"' and begins:
            quoted, begins = True, False
        elif c == "\n" and not quoted:
            out.append(now)
            now, begins, i = "", True, i + 1
            continue
        else:
            begins = c == "," and not quoted
        now, i = now + c, i + 1
    return [r for r in [*out, now] if r.strip(" ")]


def value(rng):
    plain = lambda: "".join(rng.choice("ab \\é") for _ in range(rng.randint(0, 6))).rstrip("\\")
    inside = "".join(rng.choice(["a", "b,", "\n", '\\"', "\\\\", "\n\n", "é", ',\\"x', "\r\n", "c" * rng.randint(0, 60)]) for _ in range(rng.randint(0, 9)))
    return rng.choice([plain(), f'"{inside}"', f'"{inside}"', plain() + '"x"', f'"{inside}"tail"x'])


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(6))
def test_csv_records_at_any_split(spark, small_splits, tmp_path, seed):
    rng, want = random.Random(seed), []
    for name in "xy":
        text = "\n".join(["h1,h2,h3"] + [",".join(value(rng) for _ in range(rng.randint(1, 4))) for _ in range(40)]) + rng.choice(["", "\n"])
        (tmp_path / f"{name}.csv").write_text(text, newline="")
        own = by_hand(text)
        want += [(r.removesuffix("\r"), i == 0) for i, r in enumerate(own)]
    rows = records.csv_records(spark, str(tmp_path))
    assert records.pieces(spark, str(tmp_path), "\n").rdd.getNumPartitions() > 20
    assert sorted(map(tuple, rows.collect())) == sorted(want)


def test_csv_equals_the_reader_of_whole_files(spark, small_splits, tmp_path):
    rng = random.Random(9)
    rows = [(str(i), None if i % 7 == 0 else "".join(rng.choice(["a", ",", "\n", '"', "\\\\x", "é", " "]) for _ in range(rng.randint(1, 80))), rng.choice(["u", "v"])) for i in range(150)]
    spark.createDataFrame(rows, "id string, html string, type string").coalesce(1).write.csv(str(tmp_path / "in"), header=True, quote='"', escape="\\", quoteAll=True)
    whole = spark.read.csv(str(tmp_path / "in"), header=True, multiLine=True, inferSchema=False, **records.CSV)
    got = records.csv(spark, str(tmp_path / "in"))
    assert got.columns == whole.columns and got.count() == 150
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_csv_compressed_and_one_long_value(spark, tmp_path):
    long = "\n".join(["line, with \\\"quotes\\\""] * 4000)
    text = f'id,cluster_id,type,html_with_citations\n1,2,lead,"{long}"\n3,x,lead,"no cluster"\n5,6,lead,"a\n""\n7,8,lead\n'
    for name, put in (("a.csv.bz2", bz2.compress), ("b.csv", bytes)):
        (tmp_path / name).write_bytes(put(text.encode()))
    for k, v in {"spark.sql.files.maxPartitionBytes": "10000", "spark.sql.files.minPartitionNum": "8"}.items():
        spark.conf.set(k, v)
    try:
        rows = bulk.opinions(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(r.id for r in rows) == [1, 1, 5, 5, 7, 7]
    assert {r.html for r in rows if r.id == 1} == {long.replace('\\"', '"')}


@pytest.mark.parametrize("seed", range(4))
def test_object_members_at_any_split(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "a", "é", ",", "\n", "}}", '"}', " "]) for _ in range(rng.randint(0, 30)))
    facts = {str(i * 7) if i % 9 else f"k{i}": {"case_name": text(), "citation_count": i if i % 4 else None, "other": {"deep": {"er": [text(), {}]}}} for i in range(60)}
    (tmp_path / "a.json").write_text(json.dumps(facts, indent=rng.choice([None, 2]), ensure_ascii=bool(seed % 2)))
    (tmp_path / "b.json").write_text("{}")
    rows = {r.cluster: (r.case_name, r.citation_count) for r in bulk.cluster_meta(spark, str(tmp_path)).collect()}
    assert rows == {int(k): (m["case_name"], m["citation_count"] or 0) for k, m in facts.items() if k.isdigit()}
    assert records.pieces(spark, str(tmp_path), "}").rdd.getNumPartitions() > 20
