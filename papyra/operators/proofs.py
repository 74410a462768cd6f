"""Proof checks: quotes in sources, answers against their schema."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import plain_key


#: Quotes that one automaton may hold; it is built in every worker.
MOST_QUOTES = 100_000


def quotes_in_sources(quotes: DataFrame, sources: DataFrame, least: int = 8, gram: int = 8, most: int = MOST_QUOTES) -> DataFrame:
    """quotes (item_id, quote), sources (doc_id, text) -> pairs where the source holds the quote, white space aside. Quotes
    shorter than `least` prove nothing. Up to `most` quotes are found by one automaton in one pass over the sources, more by
    a join on their openings."""
    q = quotes.withColumn("qk", plain_key(F.col("quote"))).where(F.length("qk") >= max(least, gram)).select("item_id", "qk")
    s = sources.select("doc_id", plain_key(F.col("text")).alias("sk"))
    if q.limit(most + 1).count() > most:
        return _by_opening(q, s, gram)
    found: dict[str, list[int]] = {}
    for r in q.collect():  # at most `most` rows
        found.setdefault(r.qk, []).append(r.item_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for k, ids in found.items():
            machine.add_word(k, ids)
        machine.make_automaton()
        for pdf in batches:
            rows = [(i, d) for d, t in zip(pdf["doc_id"], pdf["sk"], strict=True) if t and found for i in {i for _, ids in machine.iter(t) for i in ids}]
            yield pd.DataFrame(rows, columns=["item_id", "doc_id"], dtype="int64")

    return s.mapInPandas(run, "item_id long, doc_id long").distinct()


def _by_opening(q: DataFrame, s: DataFrame, gram: int) -> DataFrame:
    """Sources are cut into their distinct grams; those that open a quote are met in an equi-join."""
    q = q.withColumn("g", F.substring("qk", 1, gram))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("sk") - (gram - 1)))
    grams = s.select("doc_id", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("sk"), i, F.lit(gram))))).alias("g"))
    pairs = grams.join(q.select("g").distinct(), "g", "left_semi").join(q, "g").select("doc_id", "item_id", "qk")
    return pairs.join(s, "doc_id").where(F.contains("sk", F.col("qk"))).select("item_id", "doc_id").distinct()


def answer_faults(answers: DataFrame, evidence: DataFrame, sources: DataFrame, least: int = 8) -> DataFrame:
    """answers (answer_id, status, paragraphs int), evidence (answer_id, source_id, quote), sources (source_id, text)
    -> answer_id, fault: answered without paragraphs, paragraphs without an answer, unknown sources, short or unfounded
    quotes."""
    empty = answers.where((F.col("status") == "answered") & (F.col("paragraphs") == 0)).select("answer_id", F.lit("no paragraphs").alias("fault"))
    extra = answers.where((F.col("status") != "answered") & (F.col("paragraphs") > 0)).select("answer_id", F.lit("unexpected paragraphs").alias("fault"))
    j = evidence.join(sources, "source_id", "left")
    q = plain_key(F.col("quote"))
    fault = F.when(F.col("text").isNull(), "unknown source").when(F.length(q) < least, "short quote").when(~F.contains(plain_key(F.col("text")), q), "unfounded quote")
    return empty.union(extra).union(j.select("answer_id", fault.alias("fault")).where("fault is not null"))
