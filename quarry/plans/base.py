"""Registration of queries and pieces of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_words
from ..operators.index import Index
from ..sources.store import stored_index

#: Tokens of documents: lower-cased runs of ASCII letters and digits with positions.
TOK = """
toks as (select doc_id, [x for x in regexp_split_to_array(lower(text), '[^a-z0-9]+') if x <> ''] as t from documents),
tok as (select doc_id, unnest(t) as term, generate_subscripts(t, 1) - 1 as pos from toks),
len as (select doc_id, len(t)::double as dl from toks where len(t) > 0),
st as (select count(*)::double as n, sum(dl) as total from len),
tf as (select doc_id, term, count(*)::double as tf from tok group by all),
df as (select term, count(*)::double as df, sum(tf) as ttf from tf group by all),
s as (select tf.doc_id, tf.term, tf.tf, df.df, df.ttf, len.dl, st.n, st.total, st.total / st.n as avgdl from tf join df using (term) join len using (doc_id), st)
"""
BM25 = "(ln(1 + (n - df + 0.5) / (df + 0.5)) - ln(1 + (n - df + 0.5) / (df + 0.5)) / (1 + tf / (1.2 * (0.25 + 0.75 * dl / avgdl))))"


class Registry:
    """QUERIES and ORACLES of a module."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn

        return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Index:
    """The documents' index: its postings are stored by the session's first query."""
    return stored_index(spark, f"{sf_dir}/documents.parquet", {"text": ascii_words})


def rounded(hits: DataFrame, digits: int = 6) -> DataFrame:
    """Scores rounded as the SQL's are."""
    return hits.withColumn("score", F.round("score", digits))


def best(score: str, k: int = 10) -> str:
    return f"select doc_id, round({score}, 6) as score"
