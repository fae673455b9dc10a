"""Quality classifier by co-training two views of a document.

One view is the text: shares of letters, capitals, marks and repeats, word lengths and
the like, from the whole text.  The other is what a page's metadata says: source,
language and length.  Each view has a logistic classifier, first fitted on labelled
documents.  Then the views teach each other: in every round, each marks the documents
of an unlabelled pool that it is sure of, and the other learns from them as well.  At
the end each view is calibrated on labelled documents that neither has learnt from, and
a last logistic model on the two calibrated scores gives the quality of all documents.

The classifiers are fitted with Spark ML on a sample whose bounds are parameters; the
features, the calibrated scores and the verdict are plain columns over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm.common import SPACES, own_columns, private, space_words, stage

#: Labelled documents and pool of unlabelled ones to fit on, drawn by a hash of the id.
LABELLED_ROWS, POOL_ROWS = 20_000, 20_000
ROUNDS = 3
#: A view is sure of a document at this probability of either class.
SURE = 0.95
#: One labelled document in so many is kept for calibration.
CALIBRATION = 4
#: Documents of at least this quality are kept.
THRESHOLD = 0.5
#: Values that sources and languages are hashed to.
SOURCE_SLOTS, LANG_SLOTS = 32, 16
SEED = 9

TEXT, META = "text_view", "meta_view"


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def text_view(docs: DataFrame, out: str = TEXT) -> DataFrame:
    """Add the features of the whole text; null text is an empty one."""
    own = own_columns(docs, text="string")
    t, w = private(docs, "_t"), private(docs, "_w")
    rows = docs.withColumn(t, F.coalesce(own["text"], F.lit("")))
    rows = rows.withColumn(w, space_words(F.col(t)))
    text, words = F.col(t), F.col(w)
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    size = F.length(text)
    n = F.size(words)
    nearby = F.greatest(n - 1, F.lit(0))
    same = F.size(
        F.filter(
            F.zip_with(
                F.slice(words, F.lit(1), nearby), F.slice(words, F.lit(2), nearby), lambda a, b: a == b
            ),
            lambda x: x,
        )
    )
    lines = F.size(F.split(text, "\n"))
    features = [
        F.log10(n + 1),
        _share(left(SPACES), n) / 5,
        _share(left(r"[^\p{L}]+"), size),
        5 * _share(left(r"[^\p{Lu}]+"), size),
        5 * _share(left(r"[^0-9]+"), size),
        10 * _share(left(r"[^#*$%&|<>]+"), size),
        10 * _share(left(r"[^!?]+"), size),
        10 * _share(left(r"[^.,;:]+"), size),
        _share(F.size(F.array_distinct(words)), n),
        _share(same, n),
        F.log10(_share(n, lines) + 1),
        (n == 0).cast("double"),
    ]
    return rows.withColumn(out, F.array(*[f.cast("double") for f in features])).drop(t, w)


def meta_view(docs: DataFrame, out: str = META) -> DataFrame:
    """Add the features of source, language and length; null has a slot of its own."""
    own = own_columns(docs, lang="string", source="string", n_chars="double")

    def slots(value: Column, count: int) -> list[Column]:
        slot = F.when(value.isNull(), F.lit(0)).otherwise(
            1 + F.pmod(F.xxhash64(value), F.lit(count - 1))
        )
        return [(slot == i).cast("double") for i in range(count)]

    length = F.log10(F.greatest(F.coalesce(own["n_chars"], F.lit(0.0)), F.lit(0.0)) + 1)
    features = [length, length * length / 4, *slots(own["source"], SOURCE_SLOTS), *slots(own["lang"], LANG_SLOTS)]
    return docs.withColumn(out, F.array(*features))


# --- the fitted model -----------------------------------------------------------


@dataclass(frozen=True)
class Linear:
    """A logistic model: a weight for each feature, and an intercept."""

    weights: tuple[float, ...]
    intercept: float

    def margin(self, features: Column) -> Column:
        weighed = F.zip_with(
            features, F.array(*[F.lit(float(w)) for w in self.weights]), lambda x, w: x * w
        )
        return F.aggregate(weighed, F.lit(float(self.intercept)), lambda a, x: a + x)

    def probability(self, features: Column) -> Column:
        # Kept within what exp can hold.
        m = F.greatest(F.least(self.margin(features), F.lit(500.0)), F.lit(-500.0))
        return 1 / (1 + F.exp(-m))


@dataclass(frozen=True)
class QualityModel:
    text: Linear
    meta: Linear
    text_scale: Linear
    meta_scale: Linear
    both: Linear

    def scores(self, text: Column, meta: Column) -> tuple[Column, Column, Column]:
        """Calibrated scores of the two views, and of both together."""
        t = self.text_scale.margin(F.array(self.text.margin(text)))
        m = self.meta_scale.margin(F.array(self.meta.margin(meta)))
        one = Linear((1.0,), 0.0)
        return (
            one.probability(F.array(t)), one.probability(F.array(m)),
            self.both.probability(F.array(t, m)),
        )


def _constant(width: int, quality: float) -> Linear:
    return Linear((0.0,) * width, 20.0 if quality >= 0.5 else -20.0)


def _logistic(
    rows: DataFrame, features: Column, width: int, strength: float = 1e-3, alike: bool = True
) -> Linear:
    """Fit ``label`` on an array, both classes counting alike or, for calibrated scores,
    by their rows.  One class alone gives a constant."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return _constant(width, max(counts, default=1))
    total = sum(counts.values())
    weight = F.lit(1.0)
    if alike:
        weight = F.when(F.col("label") == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0]))
    fitted = LogisticRegression(
        maxIter=50, regParam=strength, weightCol="weight", family="binomial"
    ).fit(rows.select(array_to_vector(features).alias("features"), "label", weight.alias("weight")))
    return Linear(tuple(float(x) for x in fitted.coefficients), float(fitted.intercept))


def quality_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, label)``: the majority of a document's labels, 1 if they are even.

    Rows without id or label are no labels.
    """
    own = own_columns(labels, doc_id="long", quality="int")
    rows = labels.select(own["doc_id"].alias("doc_id"), own["quality"].alias("quality"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    good = F.avg((F.col("quality") > 0).cast("double"))
    return rows.groupBy("doc_id").agg((good >= 0.5).cast("int").alias("label"))


def _drawn(df: DataFrame, rows: int, key: str = "doc_id", count: int | None = None) -> DataFrame:
    """About ``rows`` rows by a hash of the key; all if there are no more.

    With ``count``, about ``rows`` of so many rows that are wanted among all.
    """
    count = df.count() if count is None else count
    if count <= rows:
        return df
    steps = 1 << 30
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(steps))
    return df.where(draw < int(steps * rows / count))


def fit(
    views: DataFrame,
    labels: DataFrame,
    labelled_rows: int = LABELLED_ROWS,
    pool_rows: int = POOL_ROWS,
    rounds: int = ROUNDS,
    sure: float = SURE,
) -> QualityModel:
    """Co-train on a staged table ``(doc_id, text_view, meta_view)`` and the labels."""
    known = _drawn(quality_labels(labels), labelled_rows)
    sample = stage(views.join(known, "doc_id"), "quality-labelled")
    # The draw decides row by row, so only ids are joined to count the unlabelled.
    voted = quality_labels(labels)
    unlabelled = views.select("doc_id").join(voted, "doc_id", "left_anti").count()
    drawn = _drawn(views.select("doc_id", TEXT, META), pool_rows, count=unlabelled)
    pool = stage(drawn.join(voted, "doc_id", "left_anti"), "quality-pool")
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED + 1)), F.lit(CALIBRATION))
    held = sample.where(part == 0)
    learn = sample.where(part != 0).select(TEXT, META, "label")
    if held.isEmpty() or learn.isEmpty():
        held, learn = sample, sample.select(TEXT, META, "label")
    n_text, n_meta = (len(x) if x else 1 for x in (learn.select(TEXT, META).first() or (None, None)))
    text = _logistic(learn, F.col(TEXT), n_text)
    meta = _logistic(learn, F.col(META), n_meta)
    for _ in range(rounds):

        def taught(model: Linear, view: str) -> DataFrame:
            p = model.probability(F.col(view))
            marked = pool.withColumn("p", p).where((F.col("p") >= sure) | (F.col("p") <= 1 - sure))
            return marked.select(TEXT, META, (F.col("p") >= sure).cast("int").alias("label"))

        from_text, from_meta = taught(text, TEXT), taught(meta, META)
        text = _logistic(learn.unionByName(from_meta), F.col(TEXT), n_text)
        meta = _logistic(learn.unionByName(from_text), F.col(META), n_meta)
    margins = stage(
        held.select(text.margin(F.col(TEXT)).alias("t"), meta.margin(F.col(META)).alias("m"), "label"),
        "quality-margins",
    )
    text_scale = _logistic(margins, F.array("t"), 1, alike=False)
    meta_scale = _logistic(margins, F.array("m"), 1, alike=False)
    t, m = text_scale.margin(F.array("t")), meta_scale.margin(F.array("m"))
    both = _logistic(margins, F.array(t, m), 2, alike=False)
    return QualityModel(text, meta, text_scale, meta_scale, both)


def fitted_model(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, QualityModel]:
    """The staged views of all documents, and the model."""
    own = own_columns(docs, doc_id="long", lang="string", source="string", text="string", n_chars="double")
    rows = docs.select(*[c.alias(n) for n, c in own.items()])
    views = meta_view(text_view(rows)).select("doc_id", TEXT, META)
    views = stage(views, "quality-views")
    return views, fit(views, labels, **options)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``(doc_id, text_score, meta_score, quality, kept)`` of every document.

    Without labels, or with labels of one class only, every document has that
    class (good without any).
    """
    views, model = fitted_model(docs, labels, **options)
    text, meta, both = model.scores(F.col(TEXT), F.col(META))
    scored = views.select("doc_id", text.alias("text_score"), meta.alias("meta_score"), both.alias("quality"))
    return scored.withColumn("kept", F.col("quality") >= threshold)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that the model keeps; the columns of ``docs``.

    The fitted model is an expression, so each row decides for itself and no
    text moves.
    """
    _, model = fitted_model(docs, labels, **options)
    text, meta, score = (private(docs, n) for n in ("_text_view", "_meta_view", "_quality"))
    marked = meta_view(text_view(docs, text), meta)
    quality = model.scores(F.col(text), F.col(meta))[2]
    # A generated column: the filter stays above it, while one on the score itself
    # would be pushed through all steps and compute each as often as it is read.
    scored = marked.withColumn(score, F.explode_outer(F.array(quality)))
    return scored.where(F.col(score) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
