"""From labelled bibliography files to normalised studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studysift.config import ScreeningConfig
from studysift.functions import text as tx
from studysift.operators import lexicon as lx
from studysift.operators.storage import stored
from studysift.operators.validate import Validation, validate
from studysift.plans.screening import run_screening
from studysift.sources import bib
from studysift.sources.tables import REPORT_TABLES, refuse_existing, write_report

STOPWORDS_ONLY = (tx.drop_stopwords(),)


def normalise_studies(
    studies: DataFrame,
    lexicon: DataFrame | None = None,
    pos: Column | None = None,
    filters: Sequence[tx.TokenFilter] = STOPWORDS_ONLY,
) -> DataFrame:
    """Replace ``content`` by its filtered tokens in lower case; with a lexicon the tokens are lemmatised first.

    ``pos`` is the part of speech of the column ``token``; without it every token counts as a noun. Without a lexicon
    the whole chain is one projection.
    """
    if lexicon is None:
        tokens = studies.withColumn("_t", tx.tokens(F.col("content")))
        return tokens.withColumn("content", tx.normalised(F.col("_t"), filters)).drop("_t")
    tokens = stored(studies.select("doc_id", tx.tokens(F.col("content")).alias("tokens")), "tokens")
    lemmas = lx.lemmatised_tokens(tokens, lexicon, F.lit("n") if pos is None else pos)
    content = tx.normalised(F.col("tokens"), filters)
    normal = lemmas.select("doc_id", F.coalesce(content, F.lit("")).alias("content"))
    return studies.drop("content").join(normal, "doc_id").select(*studies.columns)


def load_bibliography(spark: SparkSession, folder: str) -> Validation:
    """Validated studies of the four labelled files, each with a ``doc_id`` fixed by writing the table once."""
    result = validate(bib.read_labelled(spark, folder))
    numbered = stored(result.studies.withColumn("doc_id", F.monotonically_increasing_id()), "studies")
    return Validation(numbered, result.rejects, result.duplicates, result.overlap)


def screen_bibliography(
    spark: SparkSession,
    folder: str,
    config: ScreeningConfig,
    out: str | None = None,
    lexicon: DataFrame | None = None,
    strict: bool = False,
) -> dict[str, DataFrame]:
    """Load, validate, normalise, screen, and write the report tables when ``out`` is given."""
    if out is not None:
        refuse_existing(spark, out)
    loaded = load_bibliography(spark, folder)
    if strict:
        loaded.require_valid()
    tables = run_screening(normalise_studies(loaded.studies, lexicon), config)
    if out is not None:
        write_report({name: df for name, df in tables.items() if name in REPORT_TABLES}, out)
    return tables
