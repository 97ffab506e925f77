"""Positional postings and statistics of a DataFrame's text fields."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import similarity as sim
from ..functions import text as text_functions

Analyzer = Callable[[Column], Column]
#: Statistics of up to so many terms, a short row for each, are broadcast.
MAX_BROADCAST_TERMS = 10_000


@dataclass
class Index:
    """Documents with text fields, each with an analyzer that turns a Column into an array of terms, or of (term, pos) structs.

    Nothing is computed at construction. A query's tokens are filtered by term where they are read,
    so that only matches are shuffled. Where all postings are wanted the documents are dealt out by
    key first, and a document's tokens are grouped where they are. `stored` postings, (field, term, doc_id, dl, tf,
    positions), and lengths, (field, doc_id, dl), are read instead if given: see sources.store.
    """

    docs: DataFrame
    fields: dict[str, Analyzer]
    key: str = "doc_id"
    similarity: sim.Similarity | sim.PerField = field(default_factory=sim.bm25)
    stored: DataFrame | None = None
    stored_lengths: DataFrame | None = None
    _stats: dict[str, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, docs: DataFrame, fields: str | Iterable[str], analyzer: str | Analyzer = "ascii", **options) -> Index:
        names = [fields] if isinstance(fields, str) else list(fields)
        fn = text_functions.COLUMN_ANALYZERS[analyzer] if isinstance(analyzer, str) else analyzer
        return cls(docs, {n: fn for n in names}, **options)

    def _analysed(self, name: str, dealt: bool = False) -> DataFrame:
        """(doc_id, _t): the documents' tokens, dealt out by doc_id if asked for."""
        rows = self.docs.select(F.col(self.key).alias("doc_id"), F.col(name).alias("_x"))
        return (rows.repartition("doc_id") if dealt else rows).select("doc_id", self.fields[name](F.col("_x")).alias("_t"))

    def _exploded(self, name: str, dealt: bool = False) -> DataFrame:
        """(doc_id, dl, pos, term). An outer explode: an inner one has its array computed once more by a filter that Spark infers."""
        out = self._analysed(name, dealt).select("doc_id", F.size("_t").alias("dl"), F.posexplode_outer("_t").alias("pos", "term"))
        if isinstance(out.schema["term"].dataType, StructType):
            out = out.select("doc_id", "dl", F.col("term.pos").alias("pos"), F.col("term.term").alias("term"))
        return out.where("term is not null")

    def tokens(self, name: str) -> DataFrame:
        """(doc_id, pos, term) of a field."""
        return self._exploded(name).select("doc_id", "pos", "term")

    def terms(self, name: str) -> DataFrame:
        """(term, df, ttf) of a field."""
        rows = self.stored.where(F.col("field") == name) if self.stored is not None else self._exploded(name, True).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
        return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))

    def _postings(self, name: str, where: Column | None) -> DataFrame:
        """(doc_id, term, dl, tf, positions)."""
        if self.stored is not None:
            out = self.stored.where(F.col("field") == name)
            return (out if where is None else out.where(where)).select("doc_id", "term", "dl", "tf", "positions")
        out = self._exploded(name, True) if where is None else self._exploded(name).where(where)
        return out.groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))

    def postings(self, name: str, where: Column | None = None) -> DataFrame:
        """(doc_id, term, tf, positions) of the terms that `where`, a predicate on the column term, accepts."""
        return self._postings(name, where).select("doc_id", "term", "tf", "positions")

    def lengths(self, name: str) -> DataFrame:
        """(doc_id, dl) of documents with tokens in a field."""
        if self.stored_lengths is not None:
            return self.stored_lengths.where(F.col("field") == name).select("doc_id", "dl")
        return self._analysed(name).select("doc_id", F.size("_t").alias("dl")).where("dl > 0")

    def stats(self, name: str) -> tuple[int, int]:
        """How many documents have the field, and how many tokens they hold: one scan, remembered."""
        if name not in self._stats:
            r = self.lengths(name).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            self._stats[name] = int(r[0]), int(r[1])
        return self._stats[name]

    def ids(self) -> DataFrame:
        return self.docs.select(F.col(self.key).alias("doc_id"))

    def _weighed(self, name: str, where: Column, boosts: Column | None, most_terms: int | None) -> tuple[DataFrame, sim.Stats]:
        if self.stored is not None:
            hits = self._postings(name, where).select("doc_id", "term", "dl", "tf")
        else:
            hits = self._exploded(name).where(where).groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))
        stats = hits.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
        if most_terms is not None and most_terms <= MAX_BROADCAST_TERMS:
            stats = F.broadcast(stats)
        n, total = self.stats(name)
        return hits.join(stats, "term"), sim.Stats(F.col("tf"), F.col("dl"), F.col("df"), F.col("ttf"), n, total, 1.0 if boosts is None else boosts)

    def scored(self, name: str, where: Column, boosts: Column | None = None, similarity: sim.Similarity | None = None, most_terms: int | None = None) -> DataFrame:
        """(doc_id, term, tf, score): each matching posting with its score.

        most_terms: `where` accepts no more terms than this, so that their statistics, a row for
        each, may be broadcast whatever the size of the corpus.
        """
        rows, s = self._weighed(name, where, boosts, most_terms)
        return rows.select("doc_id", "term", "tf", (similarity or sim.of_field(self.similarity, name))(s).alias("score"))

    def scored_by(self, name: str, where: Column, similarities: dict[str, sim.Similarity], most_terms: int | None = None) -> DataFrame:
        """(doc_id, similarity, score): each matching posting under several similarities, read once."""
        rows, s = self._weighed(name, where, None, most_terms)
        each = F.array(*[F.struct(F.lit(n).alias("similarity"), fn(s).cast("double").alias("score")) for n, fn in similarities.items()])
        return rows.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.similarity", "x.score")

    def in_memory(self) -> Index:
        """This index with its postings kept by the executors, as far as memory and disk allow."""
        rows = self.stored
        if rows is None:
            for f in self.fields:
                p = self._postings(f, None).select(F.lit(f).alias("field"), "term", "doc_id", "dl", "tf", "positions")
                rows = p if rows is None else rows.union(p)
        lengths = rows.select("field", "doc_id", "dl").distinct() if self.stored_lengths is None else self.stored_lengths
        return replace(self, stored=rows.persist(), stored_lengths=lengths.persist())
