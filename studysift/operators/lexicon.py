"""Lemmas by joining tokens with a lexicon table ``(surface, pos, lemma)`` that the user supplies.

Each distinct (token, pos) is resolved once. Where whole texts are lemmatised only the tokens that change travel, to every
task or as one replacement map per document; everything else stays in the document's own row. A base form is a lexicon row whose lemma
equals its surface; ``pos`` is n, v or r and everything else counts as n.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studysift.operators.joins import join_split
from studysift.operators.storage import stored

MAX_BROADCAST_LEMMAS = 200_000
MAX_SENT_LEMMAS = 1_000_000  # changed tokens that are sent to the tasks, 16 bytes and two words each

# Endings and their replacements when looking for a base form, by part of speech.
DETACHMENTS = {
    "n": (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
          ("men", "man"), ("ies", "y")),
    "v": (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "r": (),
}


def pos_of_tag(tag: Column) -> Column:
    """n, v or r from the initial of a part-of-speech tag; adjectives (J) fall to the noun default."""
    initial = F.lower(F.substring(tag, 1, 1))
    return F.when(initial.isin("n", "v", "r"), initial).otherwise("n")


def base_candidates(token: Column, pos: Column) -> Column:
    """The token and every form that an ending rule of its part of speech makes of it."""

    def stem(ending: str, replacement: str) -> Column:
        cut = F.substr(token, F.lit(1), F.length(token) - len(ending))
        return F.when(F.endswith(token, F.lit(ending)), F.concat(cut, F.lit(replacement)))

    rules = [F.when(pos == p, stem(e, r)) for p, pairs in DETACHMENTS.items() for e, r in pairs]
    return F.filter(F.array(token, *rules), lambda c: c.isNotNull())


def lemma_table(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(token, pos, lemma)`` for distinct pairs whose lemma differs from the token.

    Listed irregular forms come first together with the token itself; only without them do the ending rules apply.
    Among base forms the lexicon knows the shortest one wins, the earlier candidate on ties.
    """
    distinct = pairs.select("token", "pos").distinct()
    irregular = (
        lexicon.where("surface <> lemma")
        .groupBy(F.col("surface").alias("token"), "pos")
        .agg(F.array_sort(F.collect_set("lemma")).alias("_listed"))
    )
    known = lexicon.where("surface = lemma").select(F.col("surface").alias("form"), "pos").distinct()
    forms = F.when(F.col("_listed").isNotNull(), F.concat(F.array("token"), "_listed")).otherwise(
        base_candidates(F.col("token"), F.col("pos"))
    )
    # a token that is its own only form cannot change
    tried = distinct.join(irregular, ["token", "pos"], "left").select("token", "pos", forms.alias("_f"))
    tried = tried.where(F.size("_f") > 1).select("token", "pos", F.posexplode("_f").alias("i", "form"))
    return (
        tried.join(known, ["form", "pos"])
        .groupBy("token", "pos")
        .agg(F.min(F.struct(F.length("form").alias("n"), "i", "form")).alias("b"))
        .select("token", "pos", F.col("b.form").alias("lemma"))
        .where("token <> lemma")
    )


def _is_small(lexicon: DataFrame) -> bool:
    """Whether a lemma table may be broadcast: it has at most one row per lexicon surface and ending rule."""
    return lexicon.limit(MAX_BROADCAST_LEMMAS + 1).count() <= MAX_BROADCAST_LEMMAS


def lemmatise(tokens: DataFrame, lexicon: DataFrame, rows_per_key: int | None = None) -> DataFrame:
    """Add ``lemma`` to token rows ``(doc_id, position, token, pos)``; unknown tokens stay as they are.

    The lemmas of a small lexicon are broadcast. Otherwise they are joined by token, a frequent one split by document.
    """
    sizes = stored(tokens.groupBy("token", "pos").agg(F.count(F.lit(1)).alias("n")), "token-sizes")
    lemmas = lemma_table(sizes, lexicon)
    if _is_small(lexicon):
        joined = tokens.join(F.broadcast(lemmas), ["token", "pos"], "left")
    else:
        joined = join_split(tokens, lemmas, ["token", "pos"], sizes, rows_per_key=rows_per_key, how="left")
    return joined.withColumn("lemma", F.coalesce("lemma", "token"))


def lemma_counts(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(token, pos, lemma, n)`` of distinct tokens ``(token, pos, n)``, a stored table."""
    lemmas = lemma_table(counts, lexicon)
    lemmas = F.broadcast(lemmas) if _is_small(lexicon) else lemmas
    return counts.join(lemmas, ["token", "pos"], "left").withColumn("lemma", F.coalesce("lemma", "token"))


def lemmatised_tokens(
    tokens: DataFrame, lexicon: DataFrame, pos: Column, key: str = "doc_id", rows_per_key: int | None = None
) -> DataFrame:
    """Rows ``(key, tokens)``, a stored table, with every token replaced by its lemma.

    ``pos`` is the part of speech as an expression of the column ``token``, so a token has one lemma. The changed tokens
    are sent to the tasks up to ``MAX_SENT_LEMMAS``, whatever the size of the lexicon, and no row moves. Beyond that
    documents meet only those of their distinct tokens that change, gathered as a map that is no larger than the document.
    """
    held = tokens.select(key, F.explode(F.array_distinct("tokens")).alias("token"))
    sizes = stored(held.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token-sizes")
    lemmas = stored(lemma_table(sizes.select("token", pos.alias("pos")), lexicon).select("token", "lemma"), "lemmas")
    if lemmas.limit(MAX_SENT_LEMMAS + 1).count() <= MAX_SENT_LEMMAS:
        return _swapped(tokens, lemmas)
    changed = join_split(held, lemmas, ["token"], sizes, spread=key, rows_per_key=rows_per_key)
    maps = changed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_m"))
    return _swapped(tokens.join(maps, key, "left"))


def _swapped(rows: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """``tokens`` with every token that changes replaced, by one table of lemmas or by the map ``_m`` of each row.

    A batch looks up its distinct tokens, a row its own ones in a dictionary; a map column would be searched from the
    front for every token.
    """
    out = rows.drop("_m")
    names = out.columns
    table = None if lemmas is None else rows.sparkSession.sparkContext.broadcast(lemmas.toArrow())

    def by_table(lists: pa.ListArray) -> pa.ListArray:
        encoded = lists.values.dictionary_encode()
        words = encoded.dictionary
        found = pc.index_in(words, value_set=table.value.column("token").combine_chunks())
        lemma = table.value.column("lemma").combine_chunks().take(found)
        values = pc.coalesce(lemma, words).take(encoded.indices)
        return pa.ListArray.from_arrays(lists.offsets, values, mask=lists.is_null())

    def by_map(lists: pa.ListArray, maps: pa.MapArray) -> pa.ListArray:
        made = []
        for i in range(len(lists)):
            own, tokens = dict(maps[i].as_py() or ()), lists[i].as_py()
            made.append(tokens if not own else [own.get(t, t) for t in tokens])
        return pa.array(made, pa.list_(pa.string()))

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            made = by_table(lists) if table is not None else by_map(lists, batch.column("_m"))
            yield pa.RecordBatch.from_arrays([made if c == "tokens" else batch.column(c) for c in names], names=names)

    return rows.mapInArrow(swapped, out.schema)


def token_rows(df: DataFrame, toks: Column, key: str = "doc_id") -> DataFrame:
    """One row per token with its position (from 0)."""
    return df.select(key, toks.alias("_t")).select(key, F.posexplode_outer("_t").alias("position", "token")).where(
        F.col("token").isNotNull()
    )


def token_arrays(rows: DataFrame, column: str = "lemma", key: str = "doc_id") -> DataFrame:
    """Back to one array per document, which is no larger than the document was."""
    ordered = F.array_sort(F.collect_list(F.struct("position", F.col(column).alias("t"))))
    return rows.groupBy(key).agg(F.transform(ordered, lambda s: s["t"]).alias("tokens"))
