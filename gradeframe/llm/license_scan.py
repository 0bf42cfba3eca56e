"""Licence scan: a trained paragraph classifier, confirmed by comparison with notices.

Paragraphs (lines) become sets of words and word pairs. A sparse logistic
regression over the n-grams that occur in licence notices tells the families
apart, with one more class for everything else. That class is calibrated: on
paragraphs held back from training, the probability that a family must reach is
set so that no more than ``false_share`` of ordinary paragraphs reach it. What
is predicted is confirmed if it shares enough word pairs with a notice of the
family.

Everything runs in DataFrame functions and Spark ML. ``scan`` turns all
paragraphs into n-gram vectors once and writes them out for both training and
scoring; only predicted paragraphs are grouped by document.

The notices and pieces of them are trained against all distinct paragraphs of
the table (told apart by a 64-bit hash and their n-grams): one half, chosen by
hash, for the class of other text, the other half for the threshold.

Cases: NULL and empty texts have no paragraphs and no licence. A document with
several families gets the one with the most confirmed paragraphs, then the
highest probability, then the first name. Rows that repeat are judged alike. An
empty table is scored by a model of the notices alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.llm.common import staged
from gradeframe.llm.license_texts import NOTICES

UNKNOWN = "unknown"
_WORD = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"


@dataclass(frozen=True)
class LicenseScan:
    notices: tuple[tuple[str, str], ...] = NOTICES
    piece_words: tuple[int, ...] = (8, 14)
    false_share: float = 0.001
    # Shared word pairs of the smaller of paragraph and notice that confirm a prediction.
    overlap: float = 0.7
    seed: int = 0


@dataclass(frozen=True)
class LicenseModel:
    grams: CountVectorizerModel
    classes: LogisticRegressionModel
    families: tuple[str, ...]
    threshold: float


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def pairs_of(words: Column) -> Column:
    """Neighbouring words, joined by a blank."""
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(F.slice(words, 1, F.size(rest)), rest, lambda a, b: F.concat(a, F.lit(" "), b))


def _notices(spark: SparkSession, job: LicenseScan) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in job.notices])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.family", words_of(F.col("r.text")).alias("words"))


def _overlap(shared: Column, n_pairs: Column, notice: Column) -> Column:
    """The number of shared word pairs as a share of the smaller set."""
    return F.coalesce(F.try_divide(shared, F.least(n_pairs, F.size(notice))), F.lit(0.0))


def _common(shared: str, notice: Column) -> Column:
    """How many of the distinct pairs a notice has."""
    return F.size(F.filter(shared, lambda p: F.array_contains(notice, p)))


def _families(job: LicenseScan) -> tuple[str, ...]:
    return tuple(sorted({f for f, _ in job.notices}))


def _known(spark: SparkSession, job: LicenseScan) -> DataFrame:
    """label (from 1) and grams of the notices and of pieces of them."""
    pieces = [F.array(F.col("words"))]
    for size in job.piece_words:
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)), F.lit(max(1, size // 4)))
        pieces.append(F.transform(starts, lambda i, size=size: F.slice("words", i + 1, size)))
    known = _notices(spark, job).select("family", F.explode(F.array_distinct(F.flatten(F.array(*pieces)))).alias("words"))
    label = F.array_position(F.array(*[F.lit(f) for f in _families(job)]), F.col("family")).cast("double")
    return known.select(label.alias("label"), F.concat("words", pairs_of(F.col("words"))).alias("grams"))


def _vocabulary(spark: SparkSession, job: LicenseScan) -> CountVectorizerModel:
    return CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=50_000).fit(_known(spark, job))


def _paragraphs(docs: DataFrame, grams: CountVectorizerModel, job: LicenseScan, id_col: str, text_col: str) -> DataFrame:
    """id, row (hash of the text), paragraph number, h (hash of the line, NULL if blank), shared, n_pairs, near and features.

    ``shared`` are the distinct word pairs that notices have too, ``n_pairs`` the number of all (0 without shared ones).
    """
    # The notices are a fixed list.
    pairs = _notices(docs.sparkSession, job).select(F.array_distinct(pairs_of(F.col("words"))).alias("p")).collect()
    notices = [list(p) for p in sorted({tuple(r.p) for r in pairs if r.p})]
    every = sorted({p for notice in notices for p in notice})
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.split(text_col, "\n").alias("lines"))
    lines = rows.select("id", "row", F.posexplode("lines").alias("paragraph", "line"))
    split = lines.select(
        "id", "row", "paragraph", F.when(F.trim("line") != "", F.xxhash64("line", F.lit(job.seed + 1))).alias("h"),
        words_of(F.col("line")).alias("words")).withColumn("pairs", pairs_of(F.col("words")))
    split = split.withColumn("shared", F.array_distinct(F.filter("pairs", lambda p: p.isin(every))))
    split = split.withColumn("n_pairs", F.when(F.size("shared") > 0, F.size(F.array_distinct("pairs"))).otherwise(0))
    # Paragraphs that are notices do not stand for other text. The pairs shared with all notices
    # bound those shared with one, so few notices are compared.
    least = job.overlap / 2
    sized = F.array(*[F.struct(F.lit(len(n)).alias("n"), F.lit(n).alias("pairs")) for n in notices])
    near = F.exists(sized, lambda n: (
        (F.size("shared") >= F.least("n_pairs", n["n"]) * (least - 1e-9))
        & (_overlap(_common("shared", n["pairs"]), F.col("n_pairs"), n["pairs"]) >= least)))
    near = F.when(F.size("shared") > 0, near).otherwise(F.lit(least <= 0))
    return grams.transform(split.select(
        "id", "row", "paragraph", "h", "shared", "n_pairs", near.alias("near"), F.concat("words", "pairs").alias("grams"))).drop("grams")


def train(docs: DataFrame, job: LicenseScan = LicenseScan(), id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """Notices against all of the documents' own paragraphs."""
    grams = _vocabulary(docs.sparkSession, job)
    return _fitted(staged(_paragraphs(docs, grams, job, id_col, text_col), "vectors"), grams, job)


def _fitted(paragraphs: DataFrame, grams: CountVectorizerModel, job: LicenseScan) -> LicenseModel:
    families = _families(job)
    other = staged(paragraphs.where(F.col("h").isNotNull() & ~F.col("near")).select("h", "features").distinct(), "paragraphs")
    positive = grams.transform(_known(paragraphs.sparkSession, job).coalesce(1)).select("label", "features")
    rows = positive.unionByName(other.where("pmod(h, 2) = 0").select(F.lit(0.0).alias("label"), "features"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for value, n in counts.items():
        # All classes weigh alike, but for text that is no licence.
        share = F.when(F.col("label") == value, (len(families) if value == 0 else 1) / n).otherwise(share)
    fitted = LogisticRegression(weightCol="weight", maxIter=80, regParam=2e-4, elasticNetParam=0.5, family="multinomial")
    classes = fitted.fit(rows.withColumn("weight", share * 100))
    model = LicenseModel(grams, classes, families, 0.5)
    held = staged(_scored(other.where("pmod(h, 2) = 1"), model).select("probability"), "held")
    return LicenseModel(grams, classes, families, max(0.5, _percentile(held, 1 - job.false_share) or 0.0))


def _percentile(values: DataFrame, share: float) -> float | None:
    """The exact percentile of the only column, interpolated as by Spark's ``percentile``; None without values.

    The range is narrowed by counts of bins, so that neither a task nor the driver holds all values.
    """
    v = F.col(values.columns[0])
    n, low, high = values.agg(F.count(v), F.min(v), F.max(v)).first()
    if not n:
        return None
    place = share * (n - 1)
    rank, below = int(place), 0
    while low < high:
        number = F.floor((v - low) / (high - low) * 1024)
        bins = values.where(v.between(low, high)).groupBy(number).agg(
            F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("low").collect()
        for b in bins:
            if rank < below + b.n:
                break
            below += b.n
        low, high = b.low, b.high
    reached, above = values.agg(F.count_if(v <= low), F.min(F.when(v > low, v))).first()
    after = above if reached <= rank + 1 and above is not None else low
    return low if place == rank else (rank + 1 - place) * low + (place - rank) * after


def _scored(rows: DataFrame, model: LicenseModel) -> DataFrame:
    """rows with family (the likeliest) and probability; the class of other text has no part in the choice."""
    found = model.classes.transform(rows)
    all_p = vector_to_array("probability")
    own = F.slice(all_p, 2, len(model.families))
    best = F.array_max(own)
    place = F.array_position(own, best).cast("int")
    return found.withColumns({"family": F.element_at(F.array(*[F.lit(f) for f in model.families]), place), "p": best}) \
        .drop("probability", "rawPrediction", "prediction", "features").withColumnRenamed("p", "probability")


def licensed_paragraphs(
    docs: DataFrame, model: LicenseModel, job: LicenseScan = LicenseScan(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, row (hash of the text), paragraph number, family, probability and confirmed of paragraphs that reach the threshold."""
    return _licensed(_paragraphs(docs, model.grams, job, id_col, text_col), model, job)


def _licensed(paragraphs: DataFrame, model: LicenseModel, job: LicenseScan) -> DataFrame:
    found = _scored(paragraphs, model).where(F.col("probability") >= model.threshold)
    # One row per notice, a fixed list.
    notices = _notices(paragraphs.sparkSession, job).select("family", F.array_distinct(pairs_of(F.col("words"))).alias("notice"))
    of_family = notices.groupBy("family").agg(F.collect_list("notice").alias("notices"))
    compared = found.join(F.broadcast(of_family), "family")
    near = F.exists("notices", lambda n: _overlap(_common("shared", n), F.col("n_pairs"), n) >= job.overlap)
    return compared.select("id", "row", "paragraph", "family", "probability", near.alias("confirmed"))


def scan(docs: DataFrame, job: LicenseScan = LicenseScan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, family ("unknown" without a confirmed paragraph), probability, n_confirmed, n_unconfirmed, one row per row."""
    grams = _vocabulary(docs.sparkSession, job)
    paragraphs = staged(_paragraphs(docs, grams, job, id_col, text_col), "vectors")
    found = _licensed(paragraphs, _fitted(paragraphs, grams, job), job)
    by_family = found.groupBy("id", "row", "family").agg(
        F.sum(F.col("confirmed").cast("int")).alias("yes"), F.sum((~F.col("confirmed")).cast("int")).alias("no"),
        F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("p"))
    order = F.struct(-F.col("yes"), -F.coalesce("p", F.lit(0.0)), "family")
    best = by_family.groupBy("id", "row").agg(
        F.min_by(F.struct("family", "p", "yes"), order).alias("b"),
        F.sum("yes").alias("n_confirmed"), F.sum("no").alias("n_unconfirmed"))
    best = staged(best, "licences").select(F.col("id").alias("fid"), F.col("row").alias("frow"), "b", "n_confirmed", "n_unconfirmed")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"))
    joined = rows.join(best, F.col("id").eqNullSafe(F.col("fid")) & (F.col("row") == F.col("frow")), "left")
    known = F.col("n_confirmed") > 0
    return joined.select(
        F.col("id").alias(id_col), F.when(known, F.col("b.family")).otherwise(UNKNOWN).alias("license_family"),
        F.when(known, F.col("b.p")).alias("probability"), F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"),
        F.coalesce("n_unconfirmed", F.lit(0)).cast("long").alias("n_unconfirmed"))
