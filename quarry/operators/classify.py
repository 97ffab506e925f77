"""Classification by neighbours, naive Bayes and perceptron, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_words
from . import query as Q
from .index import Index


def knn(index: Index, field: str, label: str, words: tuple[str, ...], k: int = 10, min_df: int = 1, min_tf: int = 1) -> DataFrame:
    """(class, score): the classes of the k documents most like some words; a class scores count times mean(score / best) / k."""
    hits = Q.MoreLikeThis(field, words, min_tf, min_df).hits(index)
    return knn_from_hits(hits, index.docs.select(F.col(index.key).alias("doc_id"), F.col(label).alias("class")), k)


def knn_from_hits(hits: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    top = hits.join(labels.where("class is not null"), "doc_id").orderBy(F.desc("score"), "doc_id").limit(k)
    best = top.withColumn("best", F.max("score").over(Window.partitionBy(F.lit(1))))  # k rows
    out = best.groupBy("class").agg((F.count("*") * F.avg(F.col("score") / F.col("best")) / k).alias("score"))
    return out.orderBy(F.desc("score"), "class")


def knn_fuzzy(index: Index, field: str, label: str, words: tuple[str, ...], k: int = 10) -> DataFrame:
    """As knn, with a fuzzy query."""
    hits = Q.FuzzyLikeThis(field, words).hits(index)
    return knn_from_hits(hits, index.docs.select(F.col(index.key).alias("doc_id"), F.col(label).alias("class")), k)


def knn_document(index: Index, fields: dict[str, tuple[tuple[str, ...], float]], label: str, k: int = 10) -> DataFrame:
    """As knn, over several fields, each with its words and boost."""
    q = Q.Boolean(tuple((Q.SHOULD, Q.Boost(Q.MoreLikeThis(f, w, 1, 1), b)) for f, (w, b) in fields.items()))
    return knn_from_hits(q.hits(index), index.docs.select(F.col(index.key).alias("doc_id"), F.col(label).alias("class")), k)


class NaiveBayes:
    """Counts of classes and of terms in them; all queries read these two tables."""

    def __init__(self, docs: DataFrame, text: str, label: str, tokens=ascii_words, key: str = "doc_id"):
        rows = docs.where(F.col(label).isNotNull())
        self.classes = rows.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("docs"))
        t = rows.select(F.col(key).alias("doc_id"), F.col(label).alias("class"), F.explode(tokens(F.col(text))).alias("term"))
        # hits: documents of the class with the term; terms: tokens in the class over its documents
        self.terms = t.groupBy("class", "term").agg(F.count_distinct("doc_id").alias("hits"))
        self.sizes = t.groupBy("class").agg(F.count("*").alias("tokens"))

    def cached(self) -> NaiveBayes:
        """The counts kept in memory for many queries."""
        self.classes, self.terms, self.sizes = self.classes.cache(), self.terms.cache(), self.sizes.cache()
        return self

    def scores(self, words: DataFrame) -> DataFrame:
        """(id, class, score): log-scores of texts given as (id, term), and their normalised probabilities (prob).

        A class scores ln(docs / all docs) + sum of ln((hits + 1) / (tokens per document + docs)).
        """
        total = self.classes.agg(F.sum("docs").alias("n"))
        prior = self.classes.join(self.sizes, "class").crossJoin(F.broadcast(total))  # one row
        prior = prior.select("class", "docs", (F.log(F.col("docs").cast("double")) - F.log(F.col("n").cast("double"))).alias("prior"), (F.col("tokens") / F.col("docs") + F.col("docs")).alias("den"))
        pairs = words.join(F.broadcast(prior), F.lit(True))  # a row a class
        likely = pairs.join(self.terms, ["class", "term"], "left").withColumn("x", F.log((F.coalesce("hits", F.lit(0)) + 1) / F.col("den")))
        out = likely.groupBy("id", "class").agg((F.first("prior") + F.sum("x")).alias("score"))
        w = Window.partitionBy("id")
        return out.withColumn("prob", F.exp(F.col("score") - F.max("score").over(w)) / F.sum(F.exp(F.col("score"))).over(w) * F.exp(F.max("score").over(w)))

    def classify(self, words: DataFrame) -> DataFrame:
        """(id, class): the best class, by name if several are equal."""
        w = Window.partitionBy("id").orderBy(F.desc("score"), "class")
        return self.scores(words).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("id", "class")


def bm25_bayes(index: Index, field: str, label: str, words: list[str]) -> DataFrame:
    """(class, score): ln(docs / all) + sum over words of ln of the best BM25 score of the word in the class (at least a small floor)."""
    labels = index.docs.select(F.col(index.key).alias("doc_id"), F.col(label).alias("class")).where("class is not null")
    s = index.scored(field, F.col("term").isin(*words)).join(labels, "doc_id")
    best = s.groupBy("class", "term").agg(F.max("score").alias("m"))
    n = labels.count()
    classes = labels.groupBy("class").agg(F.log(F.count("*") / float(n)).alias("prior"))
    spark = index.docs.sparkSession
    w = spark.createDataFrame([(x,) for x in words], "term string")
    grid = classes.join(F.broadcast(w), F.lit(True))  # classes times query words
    return grid.join(best, ["class", "term"], "left").groupBy("class").agg((F.first("prior") + F.sum(F.log(F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(1e-6))))).alias("score")).orderBy(F.desc("score"), "class")


def perceptron(docs: DataFrame, text: str, label: str, epochs: int = 5, threshold: float | None = None, tokens=ascii_words, key: str = "doc_id") -> tuple[DataFrame, float]:
    """(term, weight) and a bias, of a boolean classifier trained by batch updates: in every epoch all documents are scored and the wrong ones' terms are moved, in one aggregation."""
    t = docs.where(F.col(label).isNotNull()).select(F.col(key).alias("doc_id"), F.col(label).cast("boolean").alias("y"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).cache()
    weights = t.groupBy("term").agg((F.avg(F.when(F.col("y"), 1.0).otherwise(-1.0))).alias("weight"))
    bias = threshold or 0.0
    for _ in range(epochs):
        s = t.join(weights, "term").groupBy("doc_id", "y").agg(F.avg("weight").alias("s"))
        wrong = s.where((F.col("s") > bias) != F.col("y")).select("doc_id")
        step = t.join(wrong, "doc_id").groupBy("term").agg(F.avg(F.when(F.col("y"), 0.1).otherwise(-0.1)).alias("d"))
        weights = weights.join(step, "term", "left").select("term", (F.col("weight") + F.coalesce("d", F.lit(0.0))).alias("weight"))
    return weights, bias


def perceptron_classify(docs: DataFrame, text: str, weights: DataFrame, bias: float, tokens=ascii_words, key: str = "doc_id") -> DataFrame:
    t = docs.select(F.col(key).alias("doc_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return t.join(weights, "term").groupBy("doc_id").agg((F.avg("weight") > bias).alias("label"))


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, count)."""
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("count"))


def evaluation(matrix: DataFrame) -> DataFrame:
    """(class, precision, recall, f1) of every class of a confusion matrix."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)
    a = matrix.groupBy(F.col("actual").alias("class")).agg(F.sum("count").alias("n"), F.sum(hit).alias("tp"))
    p = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("count").alias("m"))
    r = a.join(p, "class", "left").withColumn("precision", F.when(F.col("m") > 0, F.col("tp") / F.col("m")).otherwise(0.0)).withColumn("recall", F.col("tp") / F.col("n"))
    both = F.col("precision") + F.col("recall")
    return r.select("class", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"))


def accuracy(matrix: DataFrame) -> DataFrame:
    return matrix.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)) / F.sum("count")).alias("accuracy"))


def split(key: Column, test: float = 0.2, validation: float = 0.2, seed: int = 0) -> Column:
    """train, test or validation, by a hash of a key: the same wherever it is computed."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) / float(1 << 20)
    return F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train")


def min_hashes(tokens: Column, n: int = 64, seed: int = 0) -> Column:
    """The smallest hash of a token array under each of n hash functions."""
    return F.array(*[F.array_min(F.transform(tokens, _hasher(seed + i))) for i in range(n)])


def _hasher(seed: int):
    return lambda t: F.xxhash64(F.lit(seed), t)
