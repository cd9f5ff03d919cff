"""The vectoriser as an ML stage: it fits in a Pipeline in front of any estimator, can be tuned, saved and read back."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studysift.operators import selection as sel
from studysift.operators import vectorise as vz
from studysift.operators.storage import stored


class _VectoriserParams(Params):
    """Settings of the vectoriser: number of terms, score, n-gram range and smallest document frequency."""

    k = Param(Params._dummy(), "k", "number of terms", TypeConverters.toInt)
    score = Param(Params._dummy(), "score", "name of the term score", TypeConverters.toString)
    shortest = Param(Params._dummy(), "shortest", "words of the shortest n-gram", TypeConverters.toInt)
    longest = Param(Params._dummy(), "longest", "words of the longest n-gram", TypeConverters.toInt)
    minDf = Param(Params._dummy(), "minDf", "documents a term must occur in", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(k=1200, score="anova", shortest=1, longest=3, minDf=1)

    def ngram_range(self) -> tuple[int, int]:
        return self.getOrDefault(self.shortest), self.getOrDefault(self.longest)


class TermVectoriser(Estimator, _VectoriserParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits vocabulary and the k best terms on studies with ``doc_id, content, label``; adds ``entries, features``.

    ``scorer`` is a score of the user's own in place of a named one; a stage that has one cannot be saved.
    """

    @keyword_only
    def __init__(
        self, *, k: int = 1200, score: str = "anova", shortest: int = 1, longest: int = 3, minDf: int = 1,
        scorer: sel.Scorer | None = None,
    ):
        super().__init__()
        self.scorer = scorer
        self._set(**{name: value for name, value in self._input_kwargs.items() if name != "scorer"})

    def write(self) -> MLWriter:
        if self.scorer is not None:
            raise ValueError("a vectoriser with a scorer of its own cannot be saved")
        return super().write()

    def _fit(self, dataset: DataFrame) -> TermVectoriserModel:
        everything = F.lit(True)
        store = vz.term_store(dataset, keep=("doc_id", "label"), ngram_range=self.ngram_range())
        min_df, n_docs = self.getOrDefault(self.minDf), dataset.count()
        known = vz.with_idf(vz.store_vocabulary(store, min_df), F.lit(n_docs))
        vocabulary = stored(known.select("term", "df", "idf", "n"), "vocabulary")
        sums = sel.class_sums(store, vz.store_norms(store, n_docs, min_df), n_docs, everything, min_df)
        scores = sel.score_terms(sums, sel.class_sizes(dataset), self.scorer or self.getOrDefault(self.score))
        best = stored(sel.select_k_best(scores, self.getOrDefault(self.k)), "best-terms")
        return self._copyValues(TermVectoriserModel(vocabulary, best))


class TermVectoriserModel(Model, _VectoriserParams, MLReadable, MLWritable):
    """A fitted vocabulary ``(term, df, idf, n)`` and term choice ``(rank, term, score)``."""

    def __init__(self, vocabulary: DataFrame, best: DataFrame):
        super().__init__()
        self.vocabulary, self.best = vocabulary, best

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = vz.tfidf(vz.term_counts(dataset, ngram_range=self.ngram_range()), self.vocabulary)
        return sel.feature_vectors(dataset, weights, self.best, self.getOrDefault(self.k))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    """Settings as the library writes them, the two tables as Parquet beside them."""

    def __init__(self, instance: TermVectoriserModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.vocabulary.write.parquet(f"{path}/vocabulary")
        self.instance.best.write.parquet(f"{path}/best")


class _ModelReader(MLReader):
    def __init__(self, cls: type[TermVectoriserModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TermVectoriserModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        read = self.sparkSession.read
        model = self.cls(read.parquet(f"{path}/vocabulary"), read.parquet(f"{path}/best"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
