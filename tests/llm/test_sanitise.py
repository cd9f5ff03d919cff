import math
import random
import re
import time

from pyspark.sql import functions as F

from studysift.llm import sanitise
from tests.llm.cases import ODD, empty, odd, sha

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.c_d@e.f x@y..z a@b", "1.2.3.4.5.6.7.8 256.1.1.1 010.0.0.1 12.3.4", "+1 (555) 123-4567.8 +49.30.12345678",
    "4111 1111 1111 1111 5 5-5 4111-1111-1111-1111 4111111111111112", "é@b.c ü+1 5551234567", "😀 a@b.co 😀 1.2.3.4",
    "1 " * 20_000, "9" * 50_000, "a" * 50_000 + "@b.c", "+1" + " " * 50_000 + "5", None, "", "@", "a@b.c" * 3,
]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or "", re.A):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sanitise.digest(sanitise.personal_data(docs)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        spans = base(text)
        assert rows[i]["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)), text
        for kind in PATTERNS:
            assert rows[i][f"n_{kind}"] == sum(s[2] == kind for s in spans)


def test_odd_documents(spark):
    rows = sanitise.digest(sanitise.personal_data(odd(spark))).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" for r in rows)
    assert sanitise.personal_data(empty(spark)).count() == 0


def test_telling_terms(spark):
    """A name met with one address only is taken out, a word that mostly is generalised; common words stay."""
    texts = [f"note {i} says director Zanzibar ordered paper from boss@firm.example again" for i in range(5)]
    texts += [f"note {i} says clerk ordered paper from u{i}@x.example again" for i in range(5, 25)]
    texts += ["the director ordered paper", "Zanzi", "paper " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in sanitise.sanitised(docs).collect()}
    # D = 28, df(address) = 5: director in 6 texts, log(28 / 6) / log(28 / 5) = 0.894
    assert out[0] == "note 0 says [TERM]  ordered paper from [EMAIL] again"
    assert out[5] == "note 5 says clerk ordered paper from [EMAIL] again"
    assert [out[i] for i in (25, 26, 27)] == ["the [TERM] ordered paper", *texts[26:]]


def test_disclosure_by_hand(spark):
    texts = [f"{i} Zanzibar a@b.c" for i in range(4)] + ["Zanzibar alone"] + [f"other{i} text" for i in range(11)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sanitise.digest(sanitise.personal_data(docs)).collect()}
    # D = 16, df(c) = 4, df(t) = 5, together 4: log(4 * 16 / 20) / log(4) = 0.839
    assert rows[0]["spans"] == "generalise:2:10,email:11:16" and rows[4]["spans"] == "generalise:0:8"


def test_entities_of_a_single_document(spark):
    """A name met once, beside an address met once, is taken out; a term of two documents is judged, not passed over."""
    texts = ["Xanthippe Quill wrote from x@y.example today", "Quill wrote from home"]
    texts += [f"wrote from town{i} today" for i in range(62)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in sanitise.sanitised(docs).collect()}
    # D = 64: df 1 gives 1, df 2 gives log(32) / log(64) = 0.833, df 63 and 64 next to nothing
    assert out[0] == " [NAME] wrote from [EMAIL] today" and out[1] == "[NAME] wrote from home"
    rows = {r["doc_id"]: r for r in sanitise.digest(sanitise.personal_data(docs)).collect()}
    assert rows[0]["spans"].startswith("remove:0:9,")


def test_one_text_with_very_many_entities(spark):
    """16,000 addresses in one text, among them entities that overlap, are found at their places."""
    parts = [f"word{i % 97} Zed{i} u{i}@x{i % 50}.example.org é" for i in range(16_000)]
    text = " ".join(parts) + " 1.2.3.4@a.b"
    docs = spark.createDataFrame([(1, text), (2, "plain words"), (3, "😀 " * 3000 + "a@b.c")], "doc_id long, text string")
    begin = time.time()
    rows = {r["doc_id"]: r for r in sanitise.digest(sanitise.personal_data(docs)).collect()}
    assert time.time() - begin < 200  # 7 s once code is warm
    spans = base(text)
    assert rows[1]["n_email"] == 16_001 and rows[1]["n_ip"] == 1
    assert rows[1]["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans))
    assert rows[3]["spans"] == "email:6000:6005"
    out = {r["doc_id"]: r["text"] for r in sanitise.sanitised(docs).collect()}
    assert out[1].count("[EMAIL]") == 16_001 and "@" not in out[1] and out[2] == "plain words"
    assert out[3] == "😀 " * 3000 + "[EMAIL]"


def test_terms_that_overlap_entities(spark):
    terms = [(1, 0, 4), (1, 5, 9), (1, 12, 15), (1, 20, 25), (2, 3, 6), (3, 0, 2)]
    found = [(1, 4, 5), (1, 8, 11), (1, 9, 13), (1, 10, 11), (1, 25, 30), (2, 0, 50), (4, 0, 9)]
    schema = "row long, start int, end int"
    got = sanitise.outside(spark.createDataFrame(terms, schema).withColumn("term", F.lit("t")), spark.createDataFrame(found, schema))
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(1, 0, 4), (1, 20, 25), (3, 0, 2)]


def test_mentions_far_off_and_without_the_entity(spark):
    """A telling name goes wherever it stands; the same text without an entity in the corpus stays."""
    far = "plain words of every day " * 40
    texts = [f"Marguerite Oldenburg, m.o@firm.example. {far}Then Oldenburg left.", "A letter from Oldenburg."]
    texts += [f"A letter from every day {far}Then plain words left." for _ in range(62)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in sanitise.sanitised(docs).collect()}
    assert out[0] == f" [NAME], [EMAIL]. {far}Then [NAME] left." and out[1] == "A letter from [NAME]."
    assert [out[i] for i in range(2, 64)] == texts[2:]


def test_disclosure_against_all_pairs(spark):
    """Every term against every entity of its texts, one by one, and every occurrence in every text."""
    rng = random.Random(4)
    names = [f"{a}{b}" for a in ("Alda", "brin", "Corv", "dost") for b in ("mere", "holm", "wick", "Fell")]
    mails = [f"{c}@x.yy" for c in "abcdefgh"]
    texts = []
    for _ in range(120):
        parts = rng.choices(names, weights=range(1, 17), k=rng.randint(0, 4))
        for m in rng.sample(range(8), rng.choice((0, 0, 0, 1, 2))):
            parts += [mails[m], names[m]] if rng.random() < 0.9 else [mails[m]]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += texts[:5]
    terms = [{w.lower() for w in re.findall(r"[A-Za-z]{4,}", t)} for t in texts]
    held = [{t[s:e] for s, _, _, e in base(t)} for t in texts]
    told = {}
    for term in set().union(*terms):
        with_term = {i for i, t in enumerate(terms) if term in t}
        for entity in set().union(*(held[i] for i in with_term)):
            with_entity = {i for i, h in enumerate(held) if entity in h}
            d, e = len(texts), len(with_entity)
            told[term] = max(told.get(term, -9), math.log(d * len(with_term & with_entity) / (e * len(with_term))) / math.log(d / e))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in sanitise.personal_data(docs).collect()}
    acted = set()
    for i, text in enumerate(texts):
        want = [(s, o, k, e) for s, o, k, e in base(text)]
        for m in re.finditer(r"[A-Za-z]{4,}", text):
            level = told.get(m.group().lower(), 0)
            if level >= sanitise.GENERALISE:
                want.append((m.start(), 4, "remove" if level >= sanitise.REMOVE else "generalise", m.end()))
                acted.add((want[-1][2], bool(held[i])))
        assert [(s["start"], s["order"], s["kind"], s["end"]) for s in rows[i]] == sorted(want), text
    assert len(rows) == len(texts) and {("generalise", False), ("remove", True)} <= acted
