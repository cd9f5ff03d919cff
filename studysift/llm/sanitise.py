"""Personal data by pattern, and what gives it away by corpus co-occurrence.

E-mail addresses, IP addresses, card and phone numbers are found by pattern; they are the protected entities. A term
that stands in a text with an entity gives it away to the degree that it tells which entity it is: with document
frequencies over the whole corpus, the pointwise mutual information of term and entity is set against the information
content of the entity, which it reaches when the term is met with that entity only. From ``GENERALISE`` on a term is
replaced by its class, from ``REMOVE`` on it is taken out, wherever it stands in any text, also far from the entity and
in texts without one. The class comes from the corpus: a name where most texts that have the term never write it in
lower case, a plain term otherwise. No support is asked for: a term met only with an entity that is met once tells most
of all.

Only DataFrame functions are used. Entities that stand in the same texts tell the same about a term and are counted as
one set, so that a text with thousands of addresses of its own adds one row a term, not thousands. The frequencies bound
what a term can disclose at most; terms too frequent for the entities of a text are left out before they are counted
with them. Frequencies are combined within tasks before the shuffle; nothing but narrow rows is shuffled. Patterns never
go back over what they have read, so that very long runs of one character take linear time; places of matches, the text
around them and their overlaps take time in proportion to the matches of a text.

Defined results: a null text is empty and has no spans; repeated rows are returned each and count as documents; a null
``doc_id`` is carried along; an entity in every document has no information and nothing gives it away; a term that is
part of an entity is gone with it there, and acted on elsewhere if it tells; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studysift.llm.common import small, stored, text_of

RUN = 64  # matches whose sizes are added up together
PIECE = 1024  # characters of a text that are cut out together
GENERALISE, REMOVE = 0.8, 0.95
TERM = r"\p{L}{4,}"
LOCAL = "A-Za-z0-9._%+-"
# Kinds in their order, with a character that every match holds.
KINDS = [
    ("email", "@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", None, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
FOUND = "array<struct<start:int,order:int,kind:string,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function from a place in ``sizes`` to the sum of all before it.

    Sums of blocks are added up first, so that n of them take n steps of a block each.
    """

    def with_blocks(n: Column) -> Column:
        last = F.floor(F.size(n) / RUN).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(n, k * RUN + 1, F.lit(RUN)), F.lit(0), lambda t, x: t + x)
        )
        ends = F.aggregate(
            blocks, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
        )

        def before(t: Column) -> Callable[[Column], Column]:
            def at(i: Column) -> Column:
                block = F.floor(i / RUN).cast("int")
                own = F.slice(n, block * RUN + 1, i - block * RUN)
                return F.get(t, block) + F.aggregate(own, F.lit(0), lambda s, x: s + x)

            return at

        return let(ends, lambda t: body(before(t)))

    return let(sizes, with_blocks)


def located(text: Column, pattern: str) -> Column:
    """``array<struct<start, value>>`` of all matches, leftmost first; places are counted in code points."""
    between, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(p: Column) -> Column:
        def gap(i: Column) -> Column:
            return F.length(F.get(p["between"], i))

        sizes = F.transform(p["values"], lambda v, i: gap(i) + F.length(v))
        return running(
            sizes,
            lambda before: F.transform(
                p["values"], lambda v, i: F.struct((before(i) + gap(i)).alias("start"), v.alias("value"))
            ),
        )

    return let(F.struct(between.alias("between"), values.alias("values")), placed)


def in_pieces(text: Column, body: Callable[[Callable[[Column, Column], Column], Column], Column]) -> Column:
    """``body`` of a function that gives the text between two places, and of the text's length.

    The text is cut into pieces once, so that a place far into it is not counted out from the start each time.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(t: Column) -> Column:
        def between(low: Column, high: Column) -> Column:
            first = F.floor(low / PIECE).cast("int")
            part = F.slice(t["pieces"], first + 1, F.floor(high / PIECE).cast("int") - first + 1)
            return F.substring(F.array_join(part, ""), low - first * PIECE + 1, high - low)

        return body(between, t["length"])

    return let(F.struct(pieces.alias("pieces"), F.length(text).alias("length")), cut)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: d.try_cast("int") * (1 + i % 2))
    total = F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(F.when(d > 9, d - 9).otherwise(d), F.lit(0)))
    return total % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of the pattern is of its kind."""
    if kind == "ip":
        short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & passes_luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def spans_of(text: Column, order: int) -> Column:
    """Spans of one kind."""
    kind, sign, pattern = KINDS[order]

    def span(match: Column) -> Column:
        return F.struct(
            match["start"].alias("start"),
            F.lit(order).alias("order"),
            F.lit(kind).alias("kind"),
            (match["start"] + F.length(match["value"])).alias("end"),
            match["value"].alias("value"),
        )

    spans = F.transform(F.filter(located(text, pattern), lambda match: holds(kind, match["value"])), span)
    likely = F.contains(text, F.lit(sign)) if sign else F.rlike(text, F.lit("[0-9][ -]?[0-9]"))
    return F.when(likely, spans).otherwise(F.array().cast(FOUND))


def entities(text: Column) -> Column:
    """Base spans of all kinds, by start and then by kind."""
    return F.array_sort(F.concat(*[spans_of(text, order) for order in range(len(KINDS))]))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def terms_of(text: Column) -> Column:
    """``array<struct<term, name>>`` of the distinct terms; a ``name`` is nowhere in lower case in this text."""

    def told(words: Column) -> Column:
        plain = F.filter(words, lambda w: w == F.lower(w))
        other = F.array_except(F.transform(words, F.lower), plain)
        return F.concat(
            F.transform(plain, lambda w: F.struct(w.alias("term"), F.lit(False).alias("name"))),
            F.transform(other, lambda w: F.struct(w.alias("term"), F.lit(True).alias("name"))),
        )

    return let(F.array_distinct(words_of(text)), told)


def outside(terms: DataFrame, found: DataFrame) -> DataFrame:
    """Terms ``(row, start, end, ...)`` that overlap none of the entities ``(row, start, end)`` of their text.

    Both stand in one order of their starts: an entity that begins before must have ended, and the next one must begin
    after.
    """
    names = [c for c in terms.columns if c not in ("row", "start", "end")]
    entity = found.select("row", "start", "end", *[F.lit(None).alias(c) for c in names], F.lit(True).alias("base"))
    both = terms.withColumn("base", F.lit(False)).unionByName(entity)
    up = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("reached", F.max(F.when(F.col("base"), F.col("end"))).over(up))
    met = met.withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(down))
    free = F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    return met.filter(~F.col("base") & free).select(*terms.columns)


def entity_sets(found: DataFrame) -> DataFrame:
    """``(number, entity_df, mark, check)`` of the sets of entities in each document.

    Entities that stand in the same documents are one set; they are told by two 64-bit sums over the documents' numbers.
    """
    names = F.transform("found", lambda e: F.md5(F.concat(e["kind"], F.lit(":"), F.lower(e["value"]))))
    each = found.filter(F.size("found") > 0).select("number", F.explode(F.array_distinct(names)).alias("entity"))
    mark, check = F.xxhash64("number"), F.xxhash64("number", F.lit(1))
    sizes = each.groupBy("entity").agg(
        F.count("*").alias("entity_df"), F.bit_xor(mark).alias("mark"), F.bit_xor(check).alias("check")
    )
    several = stored(sizes.filter("entity_df > 1"), "repeated_entities")
    return (
        each.join(small(several, 64), "entity", "left")
        .select(
            "number",
            F.coalesce("entity_df", F.lit(1)).alias("entity_df"),
            F.coalesce("mark", mark).alias("mark"),
            F.coalesce("check", check).alias("check"),
        )
        .distinct()
    )


def disclosing(found: DataFrame, documents: int, frequency: DataFrame) -> DataFrame:
    """``(term, action, mask, disclosure)`` of the terms that give an entity away.

    ``found`` has the entities and distinct terms of each document; ``frequency`` says in how many documents a term
    stands at all, and in how many as a name. A term met with an entity is met with it in as many documents as the
    rarer of both has at most, so that its frequency alone rules most terms out.
    """

    def frequent(entity_df: str) -> Column:
        return F.lit(float(documents)) ** (1 - GENERALISE) * F.col(entity_df) ** GENERALISE * (1 + 1e-9)

    sets = stored(entity_sets(found).filter(F.col("entity_df") < documents), "entity_sets")
    most = sets.groupBy("number").agg(F.max("entity_df").alias("most"))
    terms = found.filter("terms IS NOT NULL").select("number", "terms").join(most, "number")
    terms = terms.select("number", "most", F.explode("terms.term").alias("term"))
    rare = terms.join(frequency, "term").filter(F.col("term_df") <= frequent("most")).drop("most")
    pairs = rare.join(sets, "number").filter(F.col("term_df") <= frequent("entity_df"))
    pairs = pairs.groupBy("entity_df", "mark", "check", "term", "term_df", "named").agg(F.count("*").alias("together"))
    content = F.log(F.lit(float(documents)) / F.col("entity_df"))
    mutual = F.log(F.col("together") * float(documents) / (F.col("entity_df") * F.col("term_df")))
    most_told = pairs.groupBy("term", "term_df", "named").agg(F.max(mutual / content).alias("disclosure"))
    action = F.when(F.col("disclosure") >= REMOVE, "remove").when(F.col("disclosure") >= GENERALISE, "generalise")
    mask = F.when(F.col("named") * 2 > F.col("term_df"), "[NAME]").otherwise("[TERM]")
    told = most_told.select("term", action.alias("action"), mask.alias("mask"), "disclosure").filter("action IS NOT NULL")
    return told.withColumn("mask", F.when(F.col("action") == "remove", "").otherwise(F.col("mask")))


def places(texts: DataFrame, telling: DataFrame) -> DataFrame:
    """``(row, start, end, action, mask)`` of each occurrence of a telling term in ``(row, text)``.

    Texts without any are ruled out by their distinct words first.
    """
    widest = telling.agg(F.max(F.octet_length("term"))).first()[0] or 0
    telling = small(telling.select("term", "action", "mask"), widest + 32)
    words = texts.select("row", F.explode(F.array_distinct(F.transform(words_of(F.col("text")), F.lower))).alias("term"))
    holding = stored(words.join(telling, "term", "left_semi").select("row").distinct(), "telling_texts")
    spots = texts.join(small(holding, 24), "row", "left_semi").select("row", F.explode(located(F.col("text"), TERM)).alias("w"))
    spots = spots.select(
        "row",
        F.col("w.start").alias("start"),
        (F.col("w.start") + F.length("w.value")).alias("end"),
        F.lower("w.value").alias("term"),
    )
    return spots.join(telling, "term").select("row", "start", "end", "action", "mask")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, text_key, spans``.

    A span is ``struct<start, order, kind, end, value>``; those of ``order`` 4 are added for terms, with the action as
    their kind and what stands in their place as their value.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    marked = texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text", entities(F.col("text")).alias("found"))
    terms = F.when(F.size("found") > 0, terms_of(F.col("text")))
    found = stored(
        marked.select("doc_id", "text_key", F.monotonically_increasing_id().alias("number"), "found", terms.alias("terms")),
        "personal_data",
    )
    words = texts.select(F.explode(terms_of(F.col("text"))).alias("t")).select("t.*")
    frequency = words.groupBy("term").agg(F.count("*").alias("term_df"), F.count_if("name").alias("named"))
    telling = stored(disclosing(found, found.count(), frequency), "disclosing_terms")

    # rows that share id and text share their spans
    row = F.struct("doc_id", "text_key").alias("row")
    found = found.select("doc_id", "text_key", "found", row)
    once = texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text").select(row, "text")
    added = stored(places(once, telling).distinct(), "telling_places")
    base = found.join(added.select("row").distinct(), "row", "left_semi").select("row", F.explode("found").alias("f"))
    # a term within an entity is gone with it
    added = outside(added, base.select("row", "f.start", "f.end")).groupBy("row").agg(
        F.collect_list(
            F.struct("start", F.lit(len(KINDS)).alias("order"), F.col("action").alias("kind"), "end", F.col("mask").alias("value"))
        ).alias("added")
    )
    more = F.coalesce("added", F.array().cast(FOUND))
    return found.join(added, "row", "left").select(
        "doc_id", "text_key", F.array_sort(F.concat("found", more)).alias("spans")
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, spans)``: texts with entities masked by kind, and telling terms generalised or removed."""
    spans = personal_data(docs).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    here = texts["doc_id"].eqNullSafe(spans["doc_id"]) & (texts["text_key"] == spans["text_key"])
    joined = texts.join(spans, here, "left").select(texts["doc_id"], "text", "spans")

    def step(done: Column, s: Column) -> Column:
        kind = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        mask = F.when(s["order"] == len(KINDS), s["value"]).otherwise(kind)
        part = F.struct(done["at"].alias("low"), s["start"].alias("high"), mask.alias("mask"))
        ahead = s["start"] >= done["at"]
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(ahead, F.concat(done["parts"], F.array(part))).otherwise(done["parts"]).alias("parts"),
        )

    none = F.array().cast("array<struct<low:int,high:int,mask:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("parts"))

    def masked(between: Callable[[Column, Column], Column], length: Column) -> Column:
        def put(done: Column) -> Column:
            parts = F.transform(done["parts"], lambda p: F.concat(between(p["low"], p["high"]), p["mask"]))
            return F.concat(F.array_join(parts, ""), between(done["at"], length))

        return F.aggregate("spans", start, step, put)

    return joined.select("doc_id", in_pieces(F.col("text"), masked).alias("text"), "spans")


def _tell(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the spans as text."""
    base = F.filter("spans", lambda span: span["order"] < len(KINDS))
    return found.select(
        "doc_id",
        *[_count(kind) for kind, _, _ in KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, _tell)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", _tell)).alias("spans"),
    )
