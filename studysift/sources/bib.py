"""Bibliography files as tables of entries.

Large files are split at line starts with ``@``, so many tasks read them; a piece that is no start of an entry belongs to
the value before it and is put back. A value may span lines, be braced to any depth, quoted or bare, or be joined from
parts by ``#``. A field whose braces or quotes do not close is reported by ``unread``, not dropped in silence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studysift.operators.storage import stored
from studysift.operators.validate import check_required, keep_first, to_studies

# Fixed patterns: the head of an entry "type{key," and the marks that matter within it (a braced
# part with none inside is taken as one).
_HEAD = r"^\s*@?(\w+)\s*\{\s*([^,\s]*)\s*,"
_MARKS = r"(?s)\\.|\{[^{}\\]*+\}|[{}\",#]|[^{}\",#\\]+|\\"
_NAME = r"^\s*([A-Za-z_][\w\-]*)\s*="
_JOIN = "\u0001"  # stands for a "#" outside braces and quotes
PIECE = "file STRING, entry_index BIGINT, value STRING, place STRING"


def _scan(entry: Column) -> Column:
    """Parts of an entry's body between its top-level commas, and what is left when its braces and quotes do not close.

    A fold over braces, quotes, commas and the text between them that only notes places: of cuts, and of ``#`` outside
    braces and quotes. ``depth`` is -1 once the entry has ended. The parts are then taken out of the body.
    """
    body = F.regexp_replace(entry, _HEAD, "")

    def step(s: Column, mark: Column) -> Column:
        open_ = s["depth"]
        top = (open_ == 0) & ~s["quoted"]
        ends = top & (mark == "}")
        cuts = ends | (top & (mark == ","))
        depth = F.when((open_ < 0) | ends, -1).when(mark == "{", open_ + 1).when((mark == "}") & (open_ > 0), open_ - 1)
        return F.struct(
            F.coalesce(depth, open_).alias("depth"),
            F.when((mark == '"') & (open_ == 0), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["at"] + F.length(mark)).alias("at"),
            F.when(cuts, F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"]).alias("cuts"),
            F.when(top & (mark == "#"), F.concat(s["joins"], F.array(s["at"]))).otherwise(s["joins"]).alias("joins"),
            s["body"].alias("body"),
        )

    places = F.array().cast("array<int>")
    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(False).alias("quoted"),
        F.lit(0).alias("at"),
        places.alias("cuts"),
        places.alias("joins"),
        body.alias("body"),
    )

    def parts(s: Column) -> Column:
        def cut(body: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), F.transform(s["cuts"], lambda c: c + 1))
            pieces = F.zip_with(s["cuts"], starts, lambda c, at: F.when(c.isNotNull(), F.substring(body, at + 1, c - at)))
            rest = F.substring(body, F.element_at(starts, -1) + 1, s["at"])
            return F.struct(
                F.filter(pieces, lambda p: p.isNotNull()).alias("parts"),
                F.when(s["depth"] >= 0, rest).alias("rest"),
            )

        return F.aggregate(s["joins"], s["body"], lambda text, at: F.overlay(text, F.lit(_JOIN), at + 1, F.lit(1)), cut)

    marks = F.regexp_extract_all(body, F.lit(_MARKS), F.lit(0))
    return F.aggregate(marks, start, step, parts)


def _name_and_value(part: Column) -> Column:
    def bare(piece: Column) -> Column:
        raw = F.regexp_replace(piece, r"^\s+|\s+$", "")
        enclosed = F.substr(raw, F.lit(1), F.lit(1)).isin("{", '"') & (F.length(raw) > 1)
        return F.when(enclosed, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)

    pieces = F.split(F.regexp_replace(part, _NAME, ""), _JOIN)
    value = F.trim(F.array_join(F.transform(pieces, bare), ""))
    return F.struct(F.lower(F.regexp_extract(part, _NAME, 1)).alias("n"), value.alias("v"))


def parse_entry(entry: Column) -> Column:
    """Struct ``(entry_type, key, fields, unread)`` of an entry's text; of a repeated field the last value counts.

    ``unread`` holds what is left of a body that does not close, and parts that are no field; null when there is none.
    """
    scan = _scan(entry)
    found = F.filter(scan["parts"], lambda p: F.regexp_like(p, F.lit(_NAME)))
    pairs = F.transform(found, _name_and_value)
    names = F.transform(pairs, lambda p: p["n"])
    last = F.transform(
        F.array_distinct(names),
        lambda n: F.struct(n, F.element_at(F.filter(pairs, lambda p: p["n"] == n), -1)["v"]),
    )
    odd = F.filter(scan["parts"], lambda p: ~F.regexp_like(p, F.lit(_NAME)) & F.regexp_like(p, F.lit(r"\S")))
    rest = F.concat(odd, F.when(scan["rest"].isNotNull(), F.array(scan["rest"])).otherwise(F.array().cast("array<string>")))
    return F.struct(
        F.lower(F.regexp_extract(entry, _HEAD, 1)).alias("entry_type"),
        F.regexp_extract(entry, _HEAD, 2).alias("key"),
        F.map_from_entries(last).alias("fields"),
        F.when(F.size(rest) > 0, F.array_join(rest, ",")).alias("unread"),
    )


def render_entry(key: Column, fields: dict[str, Column]) -> Column:
    """An entry's text with braced values; null fields are left out."""
    lines = [F.concat(F.lit(f"\t{name} = {{"), value.cast("string"), F.lit("}")) for name, value in fields.items()]
    return F.concat(F.lit("@article{"), key.cast("string"), F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def read_bib(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, entry_index, entry_type, key, fields, unread)`` of bibliography files or folders.

    ``entry_index`` grows in file order: the byte offset of the split, plus the number of entries before in the split,
    of which there are never more than bytes. A value that holds ``@`` at a line start is put together again, also
    where a split begins just there.
    """
    raw = spark.read.text(path, lineSep="\n@").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    )
    pieces = raw.select("value", "file", "at", F.regexp_like("value", F.lit(_HEAD)).alias("is_head"))
    whole = _across_splits(stored(pieces.mapInArrow(_rejoin, PIECE), "bibliography-pieces"))
    entries = whole.select("file", "entry_index", parse_entry(F.col("value")).alias("e"), F.col("value").alias("_v"))
    bibliographic = F.regexp_like("_v", F.lit(_HEAD)) & ~F.col("e.entry_type").isin("comment", "preamble", "string")
    return entries.where(bibliographic).select("file", "entry_index", "e.*")


def _across_splits(pieces: DataFrame) -> DataFrame:
    """``(file, entry_index, value)``: what stands headless at the start of a split goes back to the entry before it.

    Only such pieces and the last entry of each split take part, so there are no more than two rows per split, and
    none of a file that is one split.
    """
    edges = pieces.where("place <> 'within'")
    in_file = Window.partitionBy("file").orderBy("entry_index")
    numbered = edges.withColumn("owner", F.count_if(F.col("place") == "last").over(in_file))
    ordered = F.array_sort(F.collect_list(F.struct("entry_index", "value")))
    rejoined = numbered.groupBy("file", "owner").agg(ordered.alias("o")).select(
        "file", F.col("o")[0]["entry_index"].alias("entry_index"),
        F.array_join(F.transform("o", lambda o: o["value"]), "\n@").alias("value"),
    )
    return pieces.where("place = 'within'").select("file", "entry_index", "value").unionByName(rejoined)


def _rejoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append pieces that start no entry to the piece before them in the same split of a file.

    ``place`` tells pieces without a head at the start of a later split (``headless``) and the last entry of each split
    (``last``) from all others (``within``).
    """
    split, n, held, headless = None, 0, [], False

    def rows(last: bool) -> list[tuple[str, int, str, str]]:
        place = "headless" if headless else "last" if last else "within"
        return [(split[0], split[1] + n, "\n@".join(held), place)] if held else []

    for batch in batches:
        out: list[tuple[str, int, str, str]] = []
        for value, file, at, is_head in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, at) != split or is_head:
                fresh = (file, at) != split
                out += rows(fresh)
                n = 0 if fresh else n + 1
                split, held, headless = (file, at), [], fresh and at > 0 and not is_head
            held.append(value)
        yield _as_batch(out)
    yield _as_batch(rows(True))


def _as_batch(rows: list[tuple[str, int, str, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["file", "entry_index", "value", "place"])


def study_fields(entries: DataFrame) -> DataFrame:
    """Entries with the fields a study needs as columns."""
    wanted = ("uuid", "title", "abstract", "year")
    return entries.select(
        *[c for c in entries.columns if c != "fields"], *[F.col("fields")[name].alias(name) for name in wanted]
    )


# Fixed layout of a labelled folder: file name, split, category.
LABELLED_FILES = (
    ("Testing set - Excluded.bib", "test", "removed"),
    ("Testing set - Included.bib", "test", "selected"),
    ("Training set - Excluded.bib", "train", "removed"),
    ("Training set - Included.bib", "train", "selected"),
)


def read_labelled(
    spark: SparkSession, folder: str, files: Iterable[tuple[str, str, str]] = LABELLED_FILES
) -> DataFrame:
    """The four labelled files of a data set as one tagged table of entries."""
    parts = [
        study_fields(read_bib(spark, f"{folder.rstrip('/')}/{name}")).withColumns(
            {"split": F.lit(split), "category": F.lit(category)}
        )
        for name, split, category in files
    ]
    tagged = parts[0]
    for part in parts[1:]:
        tagged = tagged.unionByName(part)
    return tagged


def pool_category(mark: Column) -> Column:
    """Category of a pool entry from its own mark field."""
    return F.when(mark == "true", "selected").otherwise("removed")


def read_pool(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(studies, rejects) of a folder whose entries carry their verdict in the field ``inserir``.

    Every file is read. Titles are unique over the whole pool: the first one in (file, entry) order stays, and its
    content is the title line alone.
    """
    entries = read_bib(spark, folder).withColumn("category", pool_category(F.col("fields")["inserir"]))
    valid, rejects = check_required(study_fields(entries))
    first_file = valid.groupBy("title").agg(F.min(F.struct("file", "entry_index")).alias("_f"))
    keep = first_file.select("_f.file", "_f.entry_index")
    unique = to_studies(valid.join(keep, ["file", "entry_index"], "left_semi"))
    return unique.withColumn("content", F.substring_index("content", "\n", 1)), rejects


def deduplicated(entries: DataFrame) -> DataFrame:
    """Valid labelled entries as studies, first title of each set kept."""
    return keep_first(to_studies(check_required(entries)[0]))
