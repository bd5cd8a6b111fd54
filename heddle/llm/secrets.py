"""Operator 3: secrets in texts, false positives removed by a random forest. DataFrame and ML
pipeline operations only.

Candidates are runs of LEAST or more key-like characters, by default with a digit. The forest sees a candidate's
length, its transitions between kinds of characters, how much of it frequent words of the corpus
cover, the path it stands in (of the document and around the candidate) and neighbouring words. It
is trained from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST = 16
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
#: Fixed: forms of keys that services give out, the last three being digests in hexadecimal.
FORMATS = ["AKIA[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{36}", "glpat-[A-Za-z0-9_-]{20}", "sk_live_[A-Za-z0-9]{24,}", "xox[abprs]-[A-Za-z0-9-]{10,}", "AIza[A-Za-z0-9_-]{35}", "[0-9a-f]{32}", "[0-9a-f]{40}", "[0-9a-f]{64}"]
#: Bounds: labelled findings that train the forest (smallest hashes), and frequent words in the dictionary.
TRAIN_ROWS, DICTIONARY = 20_000, 1500
TREES, DEPTH, SEED = 20, 6, 7
NAMED = r"(?i)key|token|secret|passw|pwd|auth|credential|api"
TESTING = r"(?i)test|example|sample|fixture|mock|demo|doc"
FEATURES = ["length", "runs", "digits", "upper", "distinct", "syllables", "coverage", "slashes", "dots", "at", "depth", "testing", "assigned", "quoted", "named", "before", "before_2", "after"]


def dictionary(docs: DataFrame, text: str = "text", words: int = DICTIONARY) -> list[str]:
    """The most frequent words of 4 to 12 letters in all texts."""
    found = docs.select(F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")).alias("w")).filter(F.length("w").between(4, 12))
    return [r["w"] for r in found.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(words).collect()]


def share(value: Column, pattern: str) -> Column:
    """Share of the characters that matches of the pattern cover."""
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def candidates(docs: DataFrame, known: list[str], doc_id: str = "doc_id", text: str = "text", path: str | None = "source", least: int = LEAST, digit: bool = True) -> DataFrame:
    """A row for each candidate in whole texts: doc_id, word (its place), part (within the word),
    value, the words around it (context) and the features. ``least``: characters that a candidate has at
    least; ``digit``: whether it needs one, without which words as long come along. Null and empty
    texts have none."""
    form = CANDIDATE % least
    words = F.split(F.coalesce(text, F.lit("")), shared.SPACE + "+")
    file = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(F.col(doc_id).alias("doc_id"), file.alias("file"), words.alias("words")).select("doc_id", "file", "words", F.posexplode("words").alias("word", "around"))
    rows = rows.filter((F.length("around") >= least) & (F.col("around").rlike("[0-9]") if digit else F.lit(True)))
    near = lambda k: F.coalesce(F.get("words", F.col("word") + k), F.lit(""))
    rows = rows.select("doc_id", "file", "word", "around", near(-1).alias("prev"), near(-2).alias("prev_2"), near(1).alias("next"), F.posexplode(F.regexp_extract_all("around", F.lit(f"({form})"), 1)).alias("part", "value"))
    value, around = F.col("value"), F.col("around")
    seen = F.concat_ws(" ", "prev_2", "prev", F.call_function("substring_index", around, value, F.lit(1)))
    covered = share(F.lower(value), "|".join(sorted(known, key=lambda w: (-len(w), w)))) if known else F.lit(0.0)
    bins = lambda c: F.pmod(F.xxhash64(F.lower(c)), F.lit(16))
    features = {
        "length": F.length(value),
        "runs": F.length(F.regexp_replace(value, "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", "x")) / F.length(value),
        "digits": share(value, "[0-9]"),
        "upper": share(value, "[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "syllables": share(F.lower(value), "[b-df-hj-np-tv-z][aeiou]"),
        "coverage": covered,
        "slashes": F.regexp_count(around, F.lit("/")),
        "dots": F.regexp_count(around, F.lit("[.]")),
        "at": around.contains("@"),
        "depth": F.regexp_count("file", F.lit("/")),
        "testing": F.col("file").rlike(TESTING),
        "assigned": seen.rlike(r"[=:]\s*[\"']?$"),
        "quoted": around.rlike("^[^A-Za-z0-9]*[\"'`]"),
        "named": seen.rlike(NAMED),
        "before": bins(F.col("prev")),
        "before_2": bins(F.col("prev_2")),
        "after": bins(F.col("next")),
    }
    rows = rows.filter(value.rlike("[0-9]")) if digit else rows
    return rows.withColumns({k: v.cast("double") for k, v in features.items()}).select("doc_id", "word", "part", "value", F.concat_ws(" ", "prev_2", "prev", "around", "next").alias("context"), *FEATURES)


def classified(found: DataFrame, labelled: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``found`` with ``probability`` and ``is_secret``. ``labelled``: rows of candidates() with label 0
    or 1. Without both labels among them nothing can be learnt: all get the one label, or 1."""
    some = shared.stored(labelled.filter("label IS NOT NULL").orderBy(F.xxhash64("doc_id", "word", "part"), "value").limit(rows).select(F.col("label").cast("double").alias("label"), *FEATURES), "labelled")
    kinds = sorted(r["label"] for r in some.select("label").distinct().collect())
    if len(kinds) < 2:
        return found.withColumns({"probability": F.lit(kinds[0] if kinds else 1.0), "is_secret": F.lit(not kinds or kinds[0] > 0)})
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, rawPredictionCol="raw", probabilityCol="chances", predictionCol="guess")
    model = forest.fit(vectors.transform(some.coalesce(1)))
    out = model.transform(vectors.transform(found)).withColumn("probability", vector_to_array("chances")[1])
    return out.withColumn("is_secret", F.col("probability") >= 0.5).drop("features", "raw", "chances", "guess")


def known_forms(found: DataFrame) -> DataFrame:
    """Labelled findings where none were reviewed, by what the forest doesn't see: 1 for a value that has the
    whole form of a service's key and stands alone between quotes after an equals sign or a colon, 0
    for others; null, so not learnt from, for values of such a form elsewhere."""
    form = F.col("value").rlike(f"^(?:{'|'.join(FORMATS)})$")
    quoted = F.lit(False)
    for quote in ('"', "'"):
        quoted |= F.regexp_replace("context", r"[=:]\s*" + quote, "\u0001" + quote).contains(F.concat(F.lit("\u0001" + quote), "value", F.lit(quote)))
    return found.withColumn("label", F.when(form & quoted, 1).when(~form, 0))


def precision(judged: DataFrame) -> DataFrame:
    """Of findings with label and is_secret: the share of secrets among candidates and among what is left
    after the forest, and the share of secrets that it left."""
    right = F.col("label") > 0
    return judged.filter("label IS NOT NULL").agg((F.count_if(right) / F.count("*")).alias("before"), (F.count_if(right & F.col("is_secret")) / F.count_if("is_secret")).alias("after"), (F.count_if(right & F.col("is_secret")) / F.count_if(right)).alias("recall"))


def scan(docs: DataFrame, findings: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", least: int = LEAST, digit: bool = True) -> DataFrame:
    """All candidates of ``docs`` with probability and is_secret.

    ``findings`` (doc_id, value, label) are reviewed findings; without them labels come from
    known_forms(). Null and empty texts have no candidates; repeated rows give their candidates
    each; an empty table gives an empty result; other columns aren't looked at.
    """
    found = shared.stored(candidates(docs, dictionary(docs, text), doc_id, text, path, least, digit), "candidates")
    if findings is None:
        return classified(found, known_forms(found))
    judged = findings.groupBy("doc_id", "value").agg(F.max("label").alias("label"))
    return classified(found, found.join(judged, ["doc_id", "value"]))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "word", "part", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret")
