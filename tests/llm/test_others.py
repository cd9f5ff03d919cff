import gzip
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from studysift.llm import decontaminate, sharding, toxicity, warc
from tests.llm.cases import ODD, empty, odd, remainder, sha

# Toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    plain = ["w%d" % i for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        text = [rng.choice(plain) for _ in range(60)]
        if toxic:
            text[rng.randrange(60)] = rng.choice(["vile", "scum"])
            text[rng.randrange(60)] = "idiot,"
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.toxicity(d, known).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(1500) if remainder(i, 5) == 0}
    assert sum(r["predicted"] == (r["doc_id"] % 8 == 0) for r in held) > 0.97 * len(held)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(d, known).collect()}
    assert kept == {r["doc_id"] for r in rows if r["predicted"] == 0}


def test_toxicity_odd_documents(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None), (6, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd(spark), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(odd(spark), none).collect()} == {0.5}
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def test_ftrl_by_hand():
    """One row, one pass: z is the gradient, n its square, and the L1 term keeps small ones at zero."""
    w = toxicity.ftrl([np.array([0, 5])], np.array([1.0]), passes=1)
    z, n = -0.5, 0.25
    assert w[5] == 0.0 and np.count_nonzero(w) == 1
    assert w[0] == pytest.approx(-z / ((toxicity.BETA + n**0.5) / toxicity.ALPHA + toxicity.L2))


# Archives

PAGE = "page_id long, url string, html string, kind string"
PAGES = [
    (3, "http://a.example/x y", "<p>" + "é" * 60), (1, None, "<p>" + "é" * 60), (2, "http://a.example/", "small"),
    (4, "http://a.example/4", "small"), (5, "http://a.example/5", None), (None, "u", "<p>" + "é" * 60),
    (6, "u", "\r\n\r\nWARC/1.0\r\n\n" * 20), (7, "", "x" * 70_000), (7, "", "x" * 70_000), (8, "v", "x" * 70_000),
]


@pytest.mark.parametrize("archive_bytes", [1 << 25, 300])
def test_archives_round_trip(spark, archive_bytes):
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], PAGE).repartition(2)
    arcs, warcs = warc.new_folder(spark, "arc"), warc.new_folder(spark, "warc")
    warc.write_arc(pages, arcs, archive_bytes)
    assert {r["version"] for r in warc.read_arc(spark, arcs).collect()} == {1, 2}
    warc.convert(spark, arcs, warcs)
    rows = warc.read_warc(spark, warcs).collect()
    first = {}
    for i, _, html in PAGES:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        again = data in first and i != first[data]
        want.append((i, len(data), sha(data), "revisit" if again else "response", first[data] if again else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r["date"] for r in rows} == {"2024-01-01T00:00:00Z"}


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], PAGE)).count() == 0


def test_pages_that_look_like_version_blocks_and_repeated_rows(spark):
    """No page is lost for its url, every record has its own identifier, and revisits name the record they refer to."""
    body = "<p>" + "x" * 200
    rows = [(1, "filedesc://odd", body), (2, "http://a/b", body), (2, "http://a/b", body), (3, "filedesc://odd", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    arcs, warcs = warc.new_folder(spark, "arc"), warc.new_folder(spark, "warc")
    warc.write_arc(pages.coalesce(1), arcs)
    warc.convert(spark, arcs, warcs)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, warcs).collect())
    assert got == [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None)]
    found = []
    for name, content in warc._archives(spark, warcs).collect():
        found += warc.warc_records(gzip.decompress(bytes(content)), name)
    ids = {f["warc-record-id"]: f for f, _ in found}
    assert len(ids) == len(found) == 5
    for fields, block in found:
        if fields["warc-type"] == "revisit":
            assert ids[fields["warc-refers-to"]]["x-page-id"] == "1"
        if fields["warc-type"] == "warcinfo":
            assert b"format: WARC" in block and all(b": " in line for line in block.split(b"\r\n") if line)


def test_arc_versions_by_hand():
    one = b"filedesc://x 0.0.0.0 19990102 text/plain 8\n1 0 org\nhttp://h/a b 1.2.3.4 19990102030405 text/html 5\nhello\n"
    found = list(warc.arc_records(one, "x"))
    assert [f[1] for f in found] == [1, 1] and found[1][2][0] == "http://h/a b" and found[1][3] == b"hello"
    two = b"filedesc://x 0.0.0.0 1999 text/plain 200 - - 0 x 8\n2 0 org\nhttp://h/ 1.2.3.4 1999 text/html 200 c - 60 x 3\nabc"
    assert list(warc.arc_records(two, "x"))[1][2][5] == "c"
    for broken in (b"http://h/ 1 2 3 4\n", one[:-4], one.replace(b"1 0", b"7 0"), one.replace(b"html 5", b"html x")):
        with pytest.raises(ValueError):
            list(warc.arc_records(broken, "x"))


def test_partial_dates_and_ids(spark):
    df = spark.createDataFrame([("1999",), ("19990215",), ("19990215102030",)], "d string")
    got = [r[0] for r in df.select(warc.iso_date(F.col("d"))).collect()]
    assert got == ["1999-01-01T00:00:00Z", "1999-02-15T00:00:00Z", "1999-02-15T10:20:30Z"]


def test_files_are_plain_archives(spark):
    import glob

    pages = spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string").coalesce(1)
    arcs = warc.new_folder(spark, "arc")
    warc.write_arc(pages, arcs)
    (name,) = glob.glob(f"{arcs}/*/*.gz")
    assert gzip.open(name).read().startswith(b"filedesc://")


# Sharding


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 3000)) for i in range(4000)] + [(5000, "y" * 30_000), (5001, "y" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard_documents(docs).collect()
    load, places = {}, {}
    for r in found:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert set(load) == set(range(16)) and max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 16
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sum(r["size"] for r in found) == sum(len(t) + 1 for _, t in rows)


def test_shards_of_odd_documents(spark):
    found = sharding.shard_documents(odd(spark), shards=3).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ODD]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=str) == sorted(want, key=str)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values())
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_map_versions(spark):
    size = np.random.default_rng(0).integers(1, 1000, 512)
    table = sharding.SlotMap(spark, shards=4, slots=512)
    table.save(np.ones(512, int))
    before = table.shard.copy()
    assert table.rebalance(size) > 0 and table.version == 1
    load = np.bincount(table.shard, weights=size)
    assert load.max() - load.min() < 20 and (before != table.shard).mean() < 0.2
    table.save(np.ones(512, int))
    old = table.shard.copy()
    table.grow(size)
    moved = table.shard != old
    assert table.version == 2 and set(table.shard[moved]) == {4}
    assert 0.19 < size[moved].sum() / size.sum() <= 0.2
    saved = spark.read.parquet(table.path).groupBy("version").count().collect()
    assert {(r["version"], r["count"]) for r in saved} == {(0, 512), (1, 512)}


# Decontamination


def edit(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [out[at], "q"], ["z"]])
    return "".join(out)


def distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_against_table():
    rng = random.Random(6)
    for _ in range(200):
        pattern = "".join(rng.choice("ab") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))
        best, end = decontaminate.myers(pattern, text)
        assert best == distance_within(pattern, text)
        assert not end or distance_within(pattern, text[:end]) == best


def test_decontamination_against_all_pairs(spark):
    rng = random.Random(7)
    noise = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    items = [(i, noise(14)) for i in range(6)] + [(6, None), (7, "  "), (8, None)]
    items.append((9, items[0][1]))
    docs = [(i, noise(30) + " " + edit(rng, items[i % 6][1], i // 6) + " " + noise(30)) for i in range(48)]
    docs += [(100, None), (101, ""), (102, items[1][1].upper().replace(" ", "\n ")), (102, items[1][1]), (None, items[2][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(d, b).collect()}
    want = set()
    for i, text in docs:
        for j, item in items:
            item = decontaminate.normalise(item or "")
            if item and text:
                best = distance_within(item, decontaminate.normalise(text))
                if best <= int(len(item) * decontaminate.ERROR_RATE):
                    want.add((i, j, best))
    assert got == want and len({w[2] for w in want}) > 2
    kept = decontaminate.decontaminated(d, b)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {w[0] for w in want}


def test_items_in_blocks(spark, monkeypatch):
    b = spark.createDataFrame([(i, f"item number {i} of the test") for i in range(5)], "item_id long, text string")
    d = spark.createDataFrame([(i, f"here is item number {i} of the test") for i in range(5)], "doc_id long, text string")
    whole = {tuple(r) for r in decontaminate.matches(d, b).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 30)
    assert len(list(decontaminate.item_blocks(b))) == 5
    assert {tuple(r) for r in decontaminate.matches(d, b).collect()} == whole
    assert decontaminate.matches(empty(spark), b).count() == 0
    assert decontaminate.matches(d, b.limit(0)).count() == 0
