"""Text preparation as column expressions; everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TokenFilter = Callable[[Column], Column]

# Fixed patterns. \w is ASCII-only in Java regular expressions, so letters and numbers are spelled out.
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
VECTOR_WORD = r"[\p{L}\p{N}_]{2,}"
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"

# The usual English stop-word list of 179 entries, in its published order.
ENGLISH_STOPWORDS: tuple[str, ...] = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
    himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about against between into through during before after above below
    to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don don't should
    should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
    haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
    weren weren't won won't wouldn wouldn't
    """.split()
)


def content(title: Column, abstract: Column) -> Column:
    """Title and abstract on separate lines."""
    return F.concat_ws("\n", title, abstract)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    """What follows the first line break, or null when there is none."""
    return F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1))


def tokens(text: Column) -> Column:
    """Words and single punctuation marks, case kept."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_MARK), F.lit(0))


def vector_words(text: Column) -> Column:
    """Lower-cased runs of at least two word characters, the vectoriser's own tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(VECTOR_WORD), F.lit(0))


def spaced_words(text: Column) -> Column:
    """The lower-cased text with one blank for all between two runs of word characters; single characters stay in."""
    return F.regexp_replace(F.lower(text), F.lit(BETWEEN_WORDS), F.lit(" "))


def drop_stopwords(words: Iterable[str] = ENGLISH_STOPWORDS) -> TokenFilter:
    """Token filter that drops stop words whatever their case (a hash-set test per token)."""
    stop = list(words)
    return lambda toks: F.filter(toks, lambda t: ~F.lower(t).isin(stop))


def apply_filters(toks: Column, filters: Iterable[TokenFilter]) -> Column:
    """Run token filters in order over an array of tokens."""
    for token_filter in filters:
        toks = token_filter(toks)
    return toks


def normalised(toks: Column, filters: Iterable[TokenFilter] = ()) -> Column:
    """Filtered tokens joined by blanks and lower-cased."""
    return F.lower(F.array_join(apply_filters(toks, filters), " "))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All word n-grams with ``low <= n <= high``, each joined by one blank.

    Pass a stored column: the array is read at several offsets.
    """
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - n)
        grams = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))
        # without the guard sequence() would count downwards
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[words if n == 1 else of_length(n) for n in range(low, high + 1)])


def run_starts(ordered: Column) -> Column:
    """Positions at which a new value begins in a sorted array."""
    marked = F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i))
    return F.filter(marked, lambda i: i.isNotNull())


def run_lengths(ordered: Column, starts: Column) -> Column:
    """``(term, tf)`` for each run of a sorted array, given its run starts."""
    return F.transform(
        starts,
        lambda i, j: F.struct(
            F.get(ordered, i).alias("term"),
            (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - i).cast("int").alias("tf"),
        ),
    )


def title_preview(title: Column, category: Column, width: int = 60) -> Column:
    """Category tag and the first characters of a title, for listings."""
    tag = F.when(category == "removed", "REM").otherwise("SEL")
    return F.concat_ws(" - ", tag, F.substring(title, 1, width))
