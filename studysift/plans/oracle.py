"""The catalogue's queries as SQL for DuckDB over the same tables, written independently of the Spark plans."""

from __future__ import annotations

from studysift.functions.text import ENGLISH_STOPWORDS
from studysift.operators.lexicon import DETACHMENTS
from studysift.operators.validate import COMPARISONS
from studysift.plans.catalogue import CONFIG, CV_FOLDS, FOLDS, SEED, SMOOTHINGS, TOP_K

DOCS = """docs AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END AS abstract,
         text AS content, CAST(2000 + CAST(substr(source, 4) AS INTEGER) AS INTEGER) AS year
  FROM documents)"""

STUDIES = (
    DOCS
    + """, studies AS (
  SELECT doc_id, title, content, year, quality AS label,
         CASE WHEN quality = 1 THEN 'selected' ELSE 'removed' END AS category,
         CASE WHEN year <= 2013 THEN 'train' WHEN year > 2013 THEN 'test' END AS split
  FROM docs JOIN labels USING (doc_id)), train AS (SELECT * FROM studies WHERE split = 'train')"""
)

SCORED = (
    STUDIES
    + """, scored AS (
  SELECT *, ((doc_id * 37) % 100) / 100e0 AS RFOREST_proba, ((doc_id * 53) % 100) / 100e0 AS SVM_proba,
         CAST(((doc_id * 37) % 100) / 100e0 >= 0.5 AS INTEGER) AS RFOREST_pred,
         CAST(((doc_id * 53) % 100) / 100e0 >= 0.5 AS INTEGER) AS SVM_pred
  FROM studies), long_scores AS (
  SELECT 'RFOREST' AS classifier, doc_id, year, label, RFOREST_proba AS proba, RFOREST_pred AS pred FROM scored
  UNION ALL SELECT 'SVM', doc_id, year, label, SVM_proba, SVM_pred FROM scored)"""
)

COUNTS = """count(*) FILTER (label = 0 AND pred = 0) AS true_negatives,
  count(*) FILTER (label = 1 AND pred = 1) AS true_positives,
  count(*) FILTER (label = 1 AND pred = 0) AS false_negatives,
  count(*) FILTER (label = 0 AND pred = 1) AS false_positives"""

RATIOS = """SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END AS f FROM (
  SELECT *, (tn + tp) / CAST(tn + tp + fn + fp AS DOUBLE) AS a,
         CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0e0 END AS p,
         CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0e0 END AS r FROM (
    SELECT *, true_negatives AS tn, true_positives AS tp, false_negatives AS fn, false_positives AS fp FROM counts))"""

# n-grams by joining each word with the next ones of its document
GRAMS = """words AS (
  SELECT doc_id, label, split, w, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM (
    SELECT doc_id, label, split, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]{2,}') AS w FROM studies)),
grams AS (
  SELECT doc_id, label, split, 1 AS n, t AS term FROM words
  UNION ALL SELECT doc_id, label, split, 2, t || ' ' || w[i + 1] FROM words WHERE i + 1 <= len(w)
  UNION ALL SELECT doc_id, label, split, 3, t || ' ' || w[i + 1] || ' ' || w[i + 2] FROM words WHERE i + 2 <= len(w)),
tf AS (SELECT doc_id, label, split, term, count(*) AS tf FROM grams GROUP BY ALL)"""

IDF = """vocab AS (
  SELECT term, count(*) AS df, ln((1e0 + (SELECT count(*) FROM train)) / (1e0 + count(*))) + 1e0 AS idf
  FROM tf WHERE split = 'train' GROUP BY term)"""

FEATURES = (
    IDF
    + """, weighed AS (SELECT doc_id, label, split, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
features AS (SELECT doc_id, label, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM weighed)"""
)

SIZES = """sizes AS (
  SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS n1, CAST(sum(1 - label) AS DOUBLE) AS n0
  FROM train)"""

SUMS = """sums AS (
  SELECT term, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS d1, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS d0,
         coalesce(sum(v) FILTER (label = 1), 0e0) AS s1, coalesce(sum(v) FILTER (label = 0), 0e0) AS s0,
         sum(v) AS s, sum(v * v) AS q
  FROM features WHERE split = 'train' GROUP BY term)"""

TEXT_CTE = f"WITH {STUDIES}, {GRAMS}"
SCORE_CTE = f"{TEXT_CTE}, {FEATURES}, {SIZES}, {SUMS}"

SCORES = {
    "chi2": """pow(s1 - s * n1 / n, 2) / (s * n1 / n) + pow(s0 - s * n0 / n, 2) / (s * n0 / n)""",
    "anova": """(s1 * s1 / n1 + s0 * s0 / n0 - s * s / n) / ((q - s1 * s1 / n1 - s0 * s0 / n0) / (n - 2))""",
    "pearson": """(n * s1 - s * n1) / (sqrt(n * q - s * s) * sqrt(n * n1 - n1 * n1))""",
}

# Terms in the order of their ANOVA score at nine significant digits.
RANKED = f"""{SCORE_CTE}, scored_terms AS (SELECT term, {SCORES["anova"]} AS score FROM sums, sizes),
powers AS (SELECT term, score,
  CASE WHEN score = 0 OR isinf(score) THEN 1e0 ELSE pow(1e1, floor(log10(abs(score)))) END AS p FROM scored_terms),
ranked AS (SELECT term, score, CAST(row_number() OVER (
  ORDER BY round(score / p, 8) * p DESC NULLS LAST, term DESC) AS INTEGER) AS rank FROM powers)"""

TOKENS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]')"


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _rules() -> str:
    return ", ".join(f"('{p}', {i}, '{e}', '{r}')" for p, rs in DETACHMENTS.items() for i, (e, r) in enumerate(rs, 1))


def _neighbours(distance: str) -> str:
    return f"""near AS (
  SELECT query, neighbour, distance, label, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank
  FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, b.label, {distance} AS distance
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
  QUALIFY rank <= 5)"""


_WIDE_A, _WIDE_B = "CAST(a.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])"
EUCLIDEAN = f"list_distance({_WIDE_A}, {_WIDE_B})"
MANHATTAN = f"list_sum([abs({_WIDE_A}[i] - {_WIDE_B}[i]) FOR i IN range(1, len(a.embedding) + 1)])"

AGREEMENT = """joined AS (
  SELECT coalesce(m.uuid, r.uuid) AS uuid, coalesce(m.was_selected, r.was_selected) AS was_selected,
         coalesce(m.title, r.title) AS title, RFOREST_proba, SVM_proba, R1, R2, R3
  FROM (SELECT doc_id AS uuid, label AS was_selected, title, RFOREST_proba, SVM_proba FROM scored) m
  FULL JOIN (SELECT doc_id AS uuid, 1 - toxic AS was_selected, 'study ' || doc_id AS title,
                    CAST(doc_id * 5 % 3 AS INTEGER) AS R1, CAST(doc_id * 7 % 3 AS INTEGER) AS R2,
                    CAST(doc_id * 11 % 3 AS INTEGER) AS R3 FROM labels) r
  ON m.uuid = r.uuid AND m.was_selected = r.was_selected)"""


def _bin(column: str) -> str:
    return f"CASE WHEN {column} <= 0.5 THEN 0 WHEN {column} <= 0.6 THEN 1 ELSE 2 END"


def _agreement() -> str:
    parts = []
    for model in ("RF", "SVM"):
        mixes = {f"distance_{x}_FR": [x] for x in ("R1", "R2", "R3", model)}
        for a, b in (("R1", "R2"), ("R1", "R3"), ("R2", "R3"), ("R1", model), ("R2", model), ("R3", model)):
            mixes[f"distance_pair_{a}_{b}"] = [a, b]
        for trio in (("R1", "R2", "R3"), (model, "R2", "R3"), ("R1", model, "R3"), ("R1", "R2", model)):
            mixes["distance_group_" + "_".join(trio)] = list(trio)
        for name, who in mixes.items():
            mean = f"({' + '.join(who)}) / {len(who)}e0"
            parts.append(
                f"SELECT '{model}' AS model, '{name}' AS measure, "
                f"round(sqrt(sum(pow({mean} - FR, 2))), 6) AS distance FROM binned"
            )
    binned = f"""binned AS (SELECT R1, R2, R3, was_selected * 2 AS FR, {_bin("RFOREST_proba")} AS RF,
      {_bin("SVM_proba")} AS SVM FROM joined)"""
    return f"WITH {SCORED}, {AGREEMENT}, {binned} " + " UNION ALL ".join(parts)


def _overlap() -> str:
    parts = []
    for name, sets in COMPARISONS.items():
        keys = ", ".join(f"'{s}'" for s in sets)
        parts.append(
            f"SELECT '{name}' AS comparison, count(*) AS titles, count(DISTINCT title) AS distinct_titles, "
            f"count(*) - count(DISTINCT title) AS overlap FROM sets WHERE k IN ({keys})"
        )
    sets_cte = "sets AS (SELECT DISTINCT split || '_' || category AS k, title FROM studies)"
    return f"WITH {STUDIES}, {sets_cte} " + " UNION ALL ".join(parts)


def _sweep() -> str:
    cuts = ", ".join(
        f"('{m}', {t}e0)" for m, ts in (("RFOREST", (0.5, 0.6, 0.65, 0.7)), ("SVM", (0.5, 0.75, 0.8, 0.85))) for t in ts
    )
    return f"""WITH {SCORED}, cuts(classifier, threshold) AS (VALUES {cuts}), counts AS (
      SELECT classifier, threshold, {COUNTS} FROM (
        SELECT l.classifier, threshold, label, CAST(proba >= threshold AS INTEGER) AS pred
        FROM long_scores l JOIN cuts USING (classifier)) GROUP BY 1, 2)
      SELECT classifier, round(threshold, 6) AS threshold, true_negatives, true_positives, false_negatives,
        false_positives, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1
      FROM ({RATIOS})"""


STRATIFIED = f"""WITH {STUDIES},
 firsts AS (SELECT label, row_number() OVER (ORDER BY min((year, label, doc_id))) - 1 AS cls FROM train GROUP BY label),
 line AS (SELECT label, cls, row_number() OVER (ORDER BY cls) - 1 AS p FROM train JOIN firsts USING (label)),
 shares AS (SELECT label, p % {FOLDS} AS f, count(*) AS c FROM line GROUP BY ALL),
 ends AS (SELECT label, f, sum(c) OVER (PARTITION BY label ORDER BY f) AS e FROM shares),
 ranked AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY year, doc_id) AS r FROM train)
 SELECT doc_id, label, CAST(1 + (SELECT min(f) FROM ends e WHERE e.label = k.label AND e.e >= k.r) AS INTEGER) AS fold
 FROM ranked k"""


def _year_folds(folds: int) -> str:
    return f"""WITH RECURSIVE {STUDIES},
 years AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS r,
                  sum(count(*)) OVER (ORDER BY year DESC) AS tail FROM train GROUP BY year),
 walk(fold, r) AS (
   SELECT 1, CASE WHEN tail < 5 THEN r + 1 ELSE r END FROM years WHERE r = 1
   UNION ALL
   SELECT fold + 1, CASE WHEN tail < 5 THEN y.r + 1 ELSE y.r END FROM walk w JOIN years y ON y.r = w.r + 1
   WHERE fold < {folds}),
 cuts AS (SELECT fold, year AS cut FROM walk JOIN years USING (r))
 SELECT doc_id, year, CAST((SELECT min(fold) FROM cuts WHERE cut <= t.year) AS INTEGER) AS fold FROM train t"""


def _series(folds: int) -> str:
    return f"""WITH {STUDIES}, ranked AS (
   SELECT doc_id, row_number() OVER (ORDER BY year, label, doc_id) - 1 AS p, count(*) OVER () AS n FROM train),
 starts AS (SELECT *, n // {folds + 1} AS size, n - {folds} * (n // {folds + 1}) AS lead FROM ranked)
 SELECT doc_id, CAST(CASE WHEN p < lead THEN 0 ELSE (p - lead) // size + 1 END AS INTEGER) AS fold FROM starts"""


PR_CURVE = f"""WITH {SCORED}, points AS (
   SELECT classifier, proba AS threshold, sum(label) AS pos, count(*) AS n FROM long_scores GROUP BY 1, 2),
 summed AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS everything, sum(pos) OVER (PARTITION BY classifier) AS t
   FROM points WINDOW w AS (PARTITION BY classifier ORDER BY threshold DESC))
 SELECT classifier, round(threshold, 6) AS threshold, round(tp / CAST(everything AS DOUBLE), 6) AS precision,
        round(tp / CAST(t AS DOUBLE), 6) AS recall FROM summed WHERE tp - pos < t
 UNION ALL SELECT DISTINCT classifier, NULL, 1e0, 0e0 FROM long_scores"""

MACRO = f"""WITH {SCORED}, per_class AS (
   SELECT year AS fold, c, count(*) FILTER (label = c AND RFOREST_pred = c) AS tp,
          count(*) FILTER (label <> c AND RFOREST_pred = c) AS fp,
          count(*) FILTER (label = c AND RFOREST_pred <> c) AS fn
   FROM scored, (VALUES (0), (1)) v(c) GROUP BY 1, 2),
 rates AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0e0) AS p,
                  coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0e0) AS r FROM per_class WHERE tp + fp + fn > 0)
 SELECT fold, round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro,
        round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0e0)), 6) AS f1_macro FROM rates GROUP BY fold"""

LEMMAS = f"""WITH rows AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS token
   FROM (SELECT doc_id, {TOKENS} AS t FROM documents)),
 tagged AS MATERIALIZED (SELECT token, CASE WHEN lower(token) LIKE '%ly' THEN 'r'
   WHEN regexp_matches(lower(token), '(ed|ing|is|are|was|be)$') THEN 'v' ELSE 'n' END AS pos, count(*) AS n
   FROM rows GROUP BY 1, 2),
lexicon_words AS (SELECT token AS surface, pos FROM tagged WHERE regexp_matches(token, '^[a-z]{{2,}}$') AND n >= 3),
 irregular AS (SELECT a.surface, a.pos, b.surface AS lemma FROM lexicon_words a JOIN lexicon_words b
   ON b.pos = a.pos AND b.surface = left(a.surface, length(a.surface) - 2) || 'an' WHERE a.surface LIKE '%on'),
 lexicon AS MATERIALIZED (SELECT surface, pos, lemma FROM irregular
   UNION ALL SELECT surface, pos, surface FROM lexicon_words ANTI JOIN irregular USING (surface, pos)),
 rules(pos, i, ending, replacement) AS (VALUES {_rules()}),
 listed AS MATERIALIZED (SELECT t.token, t.pos, l.lemma FROM tagged t JOIN lexicon l
   ON l.surface = t.token AND l.pos = t.pos WHERE l.surface <> l.lemma),
 tried AS MATERIALIZED (
   SELECT token, pos, 0 AS i, token AS form FROM tagged
   UNION ALL SELECT token, pos, 1, lemma FROM listed
   UNION ALL SELECT t.token, t.pos, r.i, left(t.token, length(t.token) - length(r.ending)) || r.replacement
   FROM tagged t JOIN rules r ON r.pos = t.pos AND suffix(t.token, r.ending)
   ANTI JOIN listed l ON l.token = t.token AND l.pos = t.pos),
 known AS MATERIALIZED (SELECT c.token, c.pos, arg_min(c.form, (length(c.form), c.i, c.form)) AS form
   FROM tried c JOIN (SELECT DISTINCT surface, pos FROM lexicon WHERE surface = lemma) l
     ON l.surface = c.form AND l.pos = c.pos GROUP BY 1, 2),
 lemmas AS (SELECT t.token, t.pos, coalesce(k.form, t.token) AS lemma, t.n FROM tagged t
   LEFT JOIN known k ON k.token = t.token AND k.pos = t.pos)"""

# Entries of the chosen terms' vectors.
ENTRIES = f"""{RANKED}, x AS (
  SELECT doc_id, split, rank - 1 AS p, v FROM features JOIN ranked USING (term) WHERE rank <= {CONFIG.k})"""


def _bayes(more: str, models: str, fit: str, asked: str) -> str:
    """Gaussian naive Bayes ``nb(model, doc_id, pred, proba)`` of models ``(model, smoothing)``, each fitted on rows
    ``(model, doc_id, label)`` and asked for rows ``(model, doc_id)``; ``more`` are CTEs these use."""
    return f"""{ENTRIES}{more}, models AS MATERIALIZED ({models}), fit AS MATERIALIZED ({fit}),
 asked AS MATERIALIZED ({asked}),
 part_sums AS (SELECT model, label, p, sum(v) AS s, sum(v * v) AS q FROM fit JOIN x USING (doc_id) GROUP BY 1, 2, 3),
 grid AS (SELECT model, label, n, p FROM (SELECT model, label, count(*) AS n FROM fit GROUP BY 1, 2),
            (SELECT DISTINCT p FROM x)),
 cells AS MATERIALIZED (SELECT model, label, n, p, coalesce(s, 0) AS s, coalesce(q, 0) AS q
   FROM grid LEFT JOIN part_sums USING (model, label, p)),
 spread AS (SELECT model, max(q / n - (s / n) * (s / n)) AS widest FROM (
   SELECT model, p, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM cells GROUP BY 1, 2) GROUP BY 1),
 fitted AS MATERIALIZED (SELECT model, label, n, p, s / n AS mu, q / n - (s / n) * (s / n) + smoothing * widest AS spread
   FROM cells JOIN spread USING (model) JOIN models USING (model)),
 base AS (SELECT model, label, ln(n) - 0.5 * sum(ln(2 * pi() * spread) + mu * mu / spread) AS base
   FROM fitted GROUP BY model, label, n),
 shares AS (SELECT a.model, a.doc_id, label, sum(v * mu / spread - v * v / (2 * spread)) AS d
   FROM asked a JOIN x USING (doc_id) JOIN fitted f ON f.model = a.model AND f.p = x.p GROUP BY 1, 2, 3),
 odds AS (SELECT a.model, a.doc_id, sum(CASE label WHEN 1 THEN 1 ELSE -1 END * (b.base + coalesce(d, 0))) AS margin
   FROM asked a JOIN base b USING (model) LEFT JOIN shares USING (model, doc_id, label) GROUP BY 1, 2),
 nb AS MATERIALIZED (SELECT model, doc_id, CAST(margin > 0 AS INTEGER) AS pred,
   round(1 / (1 + exp(-greatest(least(margin, 7e2), -7e2))), 9) AS proba FROM odds)"""


def _screening_nb() -> str:
    sql = _bayes(
        "", "SELECT 0 AS model, 1e-9 AS smoothing", "SELECT 0 AS model, doc_id, label FROM train",
        "SELECT 0 AS model, doc_id FROM studies WHERE split = 'test'",
    )
    return f"{sql} SELECT doc_id, title, label, pred, round(proba, 6) AS proba FROM nb JOIN studies USING (doc_id)"


def _cv_years() -> str:
    sql = _bayes(
        f", marks AS MATERIALIZED (SELECT doc_id, fold FROM ({_year_folds(CV_FOLDS)}))",
        f"SELECT range AS model, 1e-9 AS smoothing FROM range(1, {CV_FOLDS + 1})",
        "SELECT model, doc_id, label FROM models, train JOIN marks USING (doc_id) WHERE coalesce(fold, 99) > model",
        "SELECT fold AS model, doc_id FROM marks WHERE fold IS NOT NULL",
    )
    return f"""{sql}, per_class AS (
   SELECT model AS fold, c, count(*) FILTER (label = c AND pred = c) AS tp,
          count(*) FILTER (label <> c AND pred = c) AS fp, count(*) FILTER (label = c AND pred <> c) AS fn
   FROM nb JOIN train USING (doc_id), (VALUES (0), (1)) v(c) GROUP BY 1, 2),
 rates AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0e0) AS p,
                  coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0e0) AS r FROM per_class WHERE tp + fp + fn > 0)
 SELECT CAST(fold AS INTEGER) AS fold, round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro,
        round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0e0)), 6) AS f1_macro FROM rates GROUP BY 1"""


def _cv_series() -> str:
    sql = _bayes(
        f", marks AS MATERIALIZED ({_series(CV_FOLDS)})",
        f"SELECT range AS model, 1e-9 AS smoothing FROM range(1, {CV_FOLDS + 1})",
        "SELECT model, doc_id, label FROM models, train JOIN marks USING (doc_id) WHERE fold < model",
        "SELECT model, doc_id FROM models, marks WHERE fold <= model",
    )
    return f"""{sql}, known AS (SELECT model, fold, label, proba FROM nb JOIN marks USING (doc_id) JOIN train USING (doc_id)),
 cuts AS (SELECT model, least(0.5e0, min(proba) FILTER (label = 1)) AS threshold FROM known WHERE fold < model GROUP BY 1),
 counts AS (SELECT model, threshold, {COUNTS} FROM (
   SELECT model, threshold, label, CAST(proba >= threshold AS INTEGER) AS pred
   FROM known JOIN cuts USING (model) WHERE fold = model) GROUP BY 1, 2)
 SELECT CAST(model AS INTEGER) AS fold, round(threshold, 6) AS threshold, round(f, 6) AS f1 FROM ({RATIOS})"""


def _grid_results() -> str:
    values = ", ".join(f"({i}, {s}::DOUBLE)" for i, s in enumerate(SMOOTHINGS))
    n = len(SMOOTHINGS)
    sql = _bayes(
        f", marks AS MATERIALIZED (SELECT doc_id, fold FROM ({STRATIFIED})), tried(candidate, var_smoothing) AS (VALUES {values})",
        f"SELECT fold * {n} + candidate AS model, var_smoothing AS smoothing FROM tried, (SELECT DISTINCT fold FROM marks)",
        f"SELECT model, doc_id, label FROM models, train JOIN marks USING (doc_id) WHERE fold <> model // {n}",
        f"SELECT model, doc_id FROM models JOIN marks ON fold = model // {n}",
    )
    return f"""{sql}, counts AS (SELECT model, {COUNTS} FROM nb JOIN train USING (doc_id) GROUP BY 1)
 SELECT 'gaussianNB' AS classifier, CAST(model % {n} AS INTEGER) AS candidate, var_smoothing,
        CAST(model // {n} AS INTEGER) AS fold, round(f, 6) AS score
 FROM ({RATIOS}) JOIN tried ON candidate = model % {n}"""


def _sparse(asked: str, manhattan: bool = False) -> str:
    """``near``: the five nearest training studies of the studies that meet the condition ``asked``."""
    size, shared = ("v", "least(a.v, b.v)") if manhattan else ("v * v", "a.v * b.v")
    distance = "d" if manhattan else "sqrt(d)"
    return f"""{ENTRIES}, sizes2 AS MATERIALIZED (SELECT s.doc_id, s.split, label, coalesce(sum({size}), 0) AS size
   FROM studies s LEFT JOIN x USING (doc_id) GROUP BY ALL),
 common AS (SELECT a.doc_id AS query, b.doc_id AS neighbour, sum({shared}) AS o FROM x a JOIN x b USING (p)
   WHERE a.{asked} AND b.split = 'train' GROUP BY 1, 2),
 gaps AS (SELECT a.doc_id AS query, b.doc_id AS neighbour, b.label,
     greatest(round(a.size + b.size - 2 * coalesce(o, 0), 12), 0) AS d
   FROM sizes2 a JOIN sizes2 b ON a.{asked} AND b.split = 'train' AND a.doc_id <> b.doc_id
   LEFT JOIN common c ON c.query = a.doc_id AND c.neighbour = b.doc_id),
 near AS (SELECT query, neighbour, label, {distance} AS distance,
     CAST(row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS INTEGER) AS rank FROM gaps QUALIFY rank <= 5)"""


def _screening_knn() -> str:
    return f"""{_sparse("split = 'test'")}, votes AS (SELECT query AS doc_id, avg(label) AS proba FROM near GROUP BY 1)
 SELECT doc_id, title, label, CAST(round(proba, 9) > 0.5 AS INTEGER) AS pred, round(proba, 6) AS proba
 FROM votes JOIN studies USING (doc_id)"""


SHUFFLED = f"md5(CAST(doc_id AS VARCHAR) || ':{SEED}')"

QUOTA = f"""{STUDIES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY {SHUFFLED}, doc_id) AS r FROM studies),
resplit AS (SELECT doc_id, category, year, CASE WHEN (category = 'selected') = (r <= CASE category
  WHEN 'selected' THEN 21 ELSE 104 END) THEN 'test' ELSE 'train' END AS part FROM ranked)"""


def all_oracles() -> dict[str, str]:
    stop = _quoted(ENGLISH_STOPWORDS)
    sql = {
        "bib_fields": f"""WITH {DOCS} SELECT 'article' AS entry_type, CAST(doc_id AS VARCHAR) AS key, trim(title) AS title,
            trim(abstract) AS abstract, CAST(year AS VARCHAR) AS year FROM docs""",
        "labelled_load": f"""WITH {STUDIES} SELECT doc_id, split, category, year,
            CASE split WHEN 'test' THEN 'Testing' ELSE 'Training' END || '-' ||
            CASE category WHEN 'selected' THEN 'Included' ELSE 'Excluded' END AS set_name FROM studies""",
        "pool_label": f"WITH {STUDIES} SELECT doc_id, trim(title) AS title, category FROM studies",
        "required_fields": f"""WITH {DOCS} SELECT doc_id, year, CASE WHEN coalesce(abstract, '') = '' THEN
              CASE WHEN title = '' THEN 'abstract,title' ELSE 'abstract' END
              WHEN title = '' THEN 'title' ELSE '' END AS reasons,
            coalesce(abstract, '') <> '' AND title <> '' AS valid FROM docs""",
        "studies": f"""WITH {STUDIES} SELECT doc_id AS uuid, title AS titles, content AS texts, label AS categories,
            year AS years FROM studies""",
        "first_line": f"WITH {DOCS} SELECT doc_id, title AS content FROM docs",
        "temporal_split": f"""WITH {STUDIES} SELECT doc_id, year, label, 'train' AS part FROM studies WHERE year <= 2013
            UNION ALL SELECT doc_id, year, label, 'test' FROM studies WHERE year > 2013""",
        "outcome_rows": f"""WITH {SCORED} SELECT doc_id, title, label, RFOREST_pred,
            CASE label * 2 + RFOREST_pred WHEN 0 THEN 'TN' WHEN 1 THEN 'FP' WHEN 2 THEN 'FN' ELSE 'TP' END AS outcome
            FROM scored""",
        "dedupe_first": f"""WITH {STUDIES} SELECT doc_id, split, category, title FROM studies
            QUALIFY row_number() OVER (PARTITION BY split, category, title ORDER BY doc_id) = 1""",
        "duplicate_titles": f"""WITH {STUDIES} SELECT split, category, title, count(*) AS times_seen FROM studies
            GROUP BY 1, 2, 3 HAVING count(*) > 1""",
        "set_sizes": f"""WITH {STUDIES} SELECT split, category, count(DISTINCT title) AS entries FROM studies
            GROUP BY 1, 2""",
        "surplus_titles": f"""WITH {DOCS} SELECT title FROM docs EXCEPT ALL SELECT DISTINCT title FROM docs""",
        "set_overlap": _overlap(),
        "title_intersect": f"""WITH {STUDIES} SELECT 'Testing Set' AS comparison, title FROM (
              SELECT title FROM studies WHERE split = 'test' AND label = 0
              INTERSECT SELECT title FROM studies WHERE split = 'test' AND label = 1)
            UNION ALL SELECT 'Training Set', title FROM (SELECT title FROM train WHERE label = 0
              INTERSECT SELECT title FROM train WHERE label = 1)
            UNION ALL SELECT 'Training and Testing Sets', title FROM (
              SELECT title FROM train INTERSECT SELECT title FROM studies WHERE split = 'test')""",
        "year_profile": f"""WITH {STUDIES} SELECT split, year, count(*) AS studies FROM studies
            GROUP BY ROLLUP (split, year)""",
        "year_counts": f"WITH {STUDIES} SELECT split, count(DISTINCT year) AS years FROM studies GROUP BY split",
        "year_profile_pivot": f"""WITH {STUDIES} SELECT year, count(*) FILTER (split = 'train') AS train,
            count(*) FILTER (split = 'test') AS test FROM studies GROUP BY year""",
        "reviewer_join": f"""WITH {SCORED}, {AGREEMENT} SELECT * FROM joined""",
        "agreement_distance": _agreement(),
        "proba_bins": f"""WITH {SCORED}, {AGREEMENT} SELECT uuid, RFOREST_proba, {_bin("RFOREST_proba")} AS RF
            FROM joined""",
        "model_disagreement": f"""WITH {SCORED} SELECT doc_id, title,
            CASE label * 2 + RFOREST_pred WHEN 0 THEN 'TN' WHEN 1 THEN 'FP' WHEN 2 THEN 'FN' ELSE 'TP' END AS outcome,
            RFOREST_pred FROM scored WHERE RFOREST_pred = SVM_pred""",
        "tokenize": f"""WITH rows AS (SELECT t, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS token FROM (
              SELECT {TOKENS} AS t FROM documents))
            SELECT token, count(*) AS n, CAST(max(i) AS INTEGER) AS last_position FROM rows GROUP BY token""",
        "stopword_filter": f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens,
            CAST(len(list_filter(t, lambda x: lower(x) NOT IN ({stop}))) AS INTEGER) AS kept
            FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""",
        "normalised_text": f"""SELECT doc_id, lower(array_to_string(
              list_filter(t, lambda x: lower(x) NOT IN ({stop})), ' ')) AS content
            FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""",
        "lemmatize": f"{LEMMAS} SELECT token, pos, lemma, n FROM lemmas",
        "lemmatised_text": f"""{LEMMAS}, kept AS (
              SELECT doc_id, lower(string_agg(lemma, ' ' ORDER BY i)) AS content
              FROM rows JOIN lemmas USING (token) WHERE lower(lemma) NOT IN ({stop}) GROUP BY doc_id)
            SELECT doc_id, coalesce(content, '') AS content FROM documents LEFT JOIN kept USING (doc_id)""",
        "ngrams": f"{TEXT_CTE} SELECT term, count(*) AS n FROM grams WHERE n > 1 GROUP BY term",
        "title_preview": f"""WITH {STUDIES} SELECT doc_id,
            CASE category WHEN 'removed' THEN 'REM' ELSE 'SEL' END || ' - ' || left(title, 60) AS preview FROM studies""",
        "duration_label": """WITH spans AS (SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS us
              FROM events GROUP BY user_id),
            secs AS (SELECT user_id, us // 1000000 % 86400 AS s FROM spans)
            SELECT user_id, printf('%02dh:%02dm:%02ds', s // 3600, s % 3600 // 60, s % 60) AS duration FROM secs""",
        "term_frequency": f"{TEXT_CTE} SELECT doc_id, term, CAST(tf AS INTEGER) AS tf FROM tf",
        "document_frequency": f"{TEXT_CTE} SELECT term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term",
        "vocabulary_size": f"{TEXT_CTE} SELECT count(DISTINCT term) AS vocabulary_size FROM tf WHERE split = 'train'",
        "idf": f"{TEXT_CTE}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM vocab",
        "tfidf": f"{TEXT_CTE}, {FEATURES} SELECT doc_id, term, round(v, 6) AS v FROM features",
        "score_affinity": f"""{TEXT_CTE}, {SIZES}, held AS (
              SELECT term, count(*) FILTER (label = 1) AS d1, count(*) FILTER (label = 0) AS d0
              FROM tf WHERE split = 'train' GROUP BY term)
            SELECT term, round(d1 / (n1 + d1 + d0 - d1) - d0 / (n0 + d1 + d0 - d0), 6) + 0e0 AS score
            FROM held, sizes""",
        "select_k_best": f"{RANKED} SELECT rank, term, round(score, 6) + 0e0 AS score FROM ranked WHERE rank <= {TOP_K}",
        "feature_vectors": f"""{RANKED} SELECT doc_id, rank - 1 AS position, round(v, 6) AS v
            FROM features JOIN ranked USING (term) WHERE rank <= {CONFIG.k}""",
        "seeded_shuffle": f"""SELECT doc_id, row_number() OVER (ORDER BY {SHUFFLED}, doc_id) AS position
            FROM documents""",
        "quota_split": f"WITH {QUOTA} SELECT doc_id, category, year, part AS split FROM resplit",
        "resplit_profile": f"""WITH {QUOTA}, lines AS (
              SELECT part, year, count(*) AS n, row_number() OVER (PARTITION BY part ORDER BY year) AS line
              FROM resplit GROUP BY part, year)
            SELECT CAST(coalesce(a.line, b.line) AS INTEGER) AS line, a.year AS train_year, a.n AS train_studies,
                   b.year AS test_year, b.n AS test_studies
            FROM (SELECT * FROM lines WHERE part = 'train') a
            FULL JOIN (SELECT * FROM lines WHERE part = 'test') b ON a.line = b.line""",
        "year_order": f"""WITH {STUDIES} SELECT doc_id, split, year, category,
            row_number() OVER (PARTITION BY split ORDER BY year, category, doc_id) AS position FROM studies""",
        "year_folds": _year_folds(FOLDS),
        "time_series_folds": _series(FOLDS),
        "stratified_folds": STRATIFIED,
        "head_n": f"WITH {DOCS} SELECT doc_id, title FROM docs ORDER BY {SHUFFLED}, doc_id LIMIT 10",
        "confusion": f"WITH {SCORED} SELECT classifier, {COUNTS} FROM long_scores GROUP BY classifier",
        "binary_metrics": f"""WITH {SCORED}, counts AS (SELECT classifier, {COUNTS} FROM long_scores GROUP BY 1)
            SELECT classifier, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
                   round(f, 6) AS f1 FROM ({RATIOS})""",
        "macro_metrics": MACRO,
        "threshold_sweep": _sweep(),
        "full_recall_threshold": f"""WITH {SCORED} SELECT year AS fold,
            round(least(0.5e0, min(RFOREST_proba) FILTER (label = 1)), 6) AS threshold FROM scored GROUP BY year""",
        "pr_curve": PR_CURVE,
        "class_weights": f"""WITH {STUDIES} SELECT label, count(*) AS n_class,
            round((SELECT count(*) FROM studies) / (2e0 * count(*)), 6) AS weight FROM studies GROUP BY label""",
        "best_candidate": f"""WITH {SCORED}, cuts(candidate, cut) AS (
              VALUES (0, 0.3e0), (1, 0.4e0), (2, 0.5e0), (3, 0.6e0), (4, 0.7e0)),
            counts AS (SELECT classifier, candidate, year, {COUNTS} FROM (
              SELECT classifier, candidate, year, label, CAST(proba >= cut AS INTEGER) AS pred
              FROM long_scores, cuts) GROUP BY 1, 2, 3),
            means AS (SELECT classifier, candidate, round(avg(f), 6) AS mean_score FROM ({RATIOS}) GROUP BY 1, 2)
            SELECT classifier, candidate, mean_score FROM means
            QUALIFY row_number() OVER (PARTITION BY classifier ORDER BY mean_score DESC, candidate) = 1""",
        "knn_sparse": f"""{_sparse("split = 'test'")} SELECT query, neighbour, round(distance, 6) + 0e0 AS distance, rank
            FROM near""",
        "knn_sparse_manhattan": f"""{_sparse("split = 'train'", True)}
            SELECT query, neighbour, round(distance, 6) + 0e0 AS distance, rank FROM near""",
        "screening_knn": _screening_knn(),
        "screening_nb": _screening_nb(),
        "cv_years": _cv_years(),
        "cv_series": _cv_series(),
        "grid_results": _grid_results(),
        "knn_neighbours": f"""WITH {_neighbours(EUCLIDEAN)} SELECT query, neighbour, round(distance, 6) AS distance,
            CAST(rank AS INTEGER) AS rank FROM near""",
        "knn_vote": f"""WITH {_neighbours(EUCLIDEAN)}, votes AS (
              SELECT query, label, count(*) / 5e0 AS share FROM near GROUP BY 1, 2)
            SELECT query, label, round(share, 6) AS share FROM votes
            QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(share, 9) DESC, label) = 1""",
        "knn_vote_weighted": f"""WITH {_neighbours(MANHATTAN)}, weighed AS (
              SELECT query, label, CASE WHEN min(distance) OVER (PARTITION BY query) = 0
                THEN CAST(distance = 0 AS DOUBLE) ELSE 1e0 / distance END AS w FROM near),
            votes AS (SELECT query, label, sum(w) / sum(sum(w)) OVER (PARTITION BY query) AS share
              FROM weighed GROUP BY 1, 2)
            SELECT query, label, round(share, 6) AS share FROM votes
            QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(share, 9) DESC, label) = 1""",
    }
    for name, formula in SCORES.items():
        sql[f"score_{name}"] = f"{SCORE_CTE} SELECT term, round({formula}, 6) + 0e0 AS score FROM sums, sizes"
    return sql
