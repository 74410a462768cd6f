"""Duplicate imports."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def import_duplicates(files: DataFrame, docs: DataFrame) -> DataFrame:
    """files (file_no, sha, name), docs (doc_id, sha, name) -> file_no, doc_id, reason, n_docs: for each file and reason (equal
    content, equal name) the smallest document and how many there are. Documents are grouped first, so that a frequent name
    gives one row for each file, not all pairs."""

    def by(column: str, reason: str) -> DataFrame:
        known = docs.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"))
        return files.select("file_no", column).join(known, column).select("file_no", "doc_id", F.lit(reason).alias("reason"), "n_docs")

    return by("sha", "content").union(by("name", "name"))


def _near(least: float):
    """Pairs whose matching-block ratio is at least `least`, with it. Rows come sorted by b, which is indexed once for a run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, last = SequenceMatcher(None), None
        for pdf in batches:
            ratios = []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                if b != last:
                    m.set_seq2(b)
                    last = b
                m.set_seq1(a)
                ratios.append(m.ratio())
            out = pdf.assign(ratio=ratios)
            yield out[out["ratio"] >= least]

    return run


#: Keys up to this length differ by two left-out characters at most where the ratio is 0.94.
SHORT = 26


def similar_names(files: DataFrame, docs: DataFrame, least: float = 0.94, length: int = 8) -> DataFrame:
    """Keys of `length` characters or more whose ratio is at least `least`: files (file_no, key), docs (doc_id, key).

    The ratio 2 m / (a + b) fixes how many of a key's characters may be left out for a partner of a given length, and what
    is left of both is one string. So keys of up to SHORT characters meet over (both lengths, what is left), an equi join
    in which names that share a long beginning (all of one series, say) do not all meet. Pairs with a longer key meet over
    both lengths and shared pieces of four characters. Distinct keys are compared, each pair once; the rows of a key come
    after that. Sides grow many times over when they are cut to pieces, which their estimated size does not show: they are
    merged, never broadcast."""

    def fewer(strings):
        """Each string without one of its characters."""
        without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        return F.array_distinct(F.flatten(F.transform(strings, without)))

    def partnered(df: DataFrame, key: str, mine: str, other: str, partners: DataFrame) -> DataFrame:
        """One row for each length that a partner may have and some key of partners has."""
        n = F.length(key)
        lengths = partners.select(F.length(partners.columns[0]).alias(other)).distinct()
        reach = F.sequence(F.greatest(F.lit(length), F.ceil(F.round(n * least / (2 - least), 9)).cast("int")), F.floor(F.round(n * (2 - least) / least, 9)).cast("int"))
        return df.withColumn(mine, n).withColumn(other, F.explode(reach)).join(F.broadcast(lengths), other, "left_semi")  # one row for each length

    def left(df: DataFrame, key: str, mine: str, other: str, partners: DataFrame) -> DataFrame:
        """One row for each partner length and each string that may be left of the key."""
        n, whole = F.length(key), F.array(key)
        out = n - F.ceil(F.round((n + F.col(other)) * least / 2, 9)).cast("int")  # how many may be left out
        parts = F.when(out == 0, whole).when(out == 1, fewer(whole)).otherwise(fewer(fewer(whole)))
        return partnered(df, key, mine, other, partners).where(out.between(0, 2)).withColumn("part", F.explode(parts))

    def pieces(df: DataFrame, key: str, mine: str, other: str, partners: DataFrame) -> DataFrame:
        cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - 3), lambda i: F.substring(F.col(key), i, F.lit(4))))
        return partnered(df, key, mine, other, partners).withColumn("part", F.explode(cut))

    def met(cut, x: DataFrame, y: DataFrame) -> DataFrame:
        one, two = cut(x, "a", "na", "nb", y), cut(y, "b", "nb", "na", x)
        return one.hint("merge").join(two.hint("merge"), ["na", "nb", "part"]).select("a", "b")

    files = files.select("file_no", F.col("key").alias("a")).where(F.length("a") >= length).distinct()
    docs = docs.select("doc_id", F.col("key").alias("b")).where(F.length("b") >= length).distinct()
    a, b = files.select("a").distinct(), docs.select("b").distinct()
    (short_a, long_a), (short_b, long_b) = ((k.where(n <= SHORT), k.where(n > SHORT)) for k, n in ((a, F.length("a")), (b, F.length("b"))))
    pairs = met(left, short_a, short_b).union(met(pieces, long_a, b)).union(met(pieces, short_a, long_b)).distinct()
    near = pairs.sortWithinPartitions("b").mapInPandas(_near(least), "a string, b string, ratio double")
    with_files = near.hint("merge").join(files.hint("merge"), "a")
    return with_files.hint("merge").join(docs.hint("merge"), "b").select("file_no", "doc_id", "a", "b", "ratio")
