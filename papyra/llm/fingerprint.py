"""Document fingerprints: a Merkle tree over paragraphs and sections. Built-in column functions only.

A paragraph (line) node is the SHA-256 of the line. A section is a run of paragraphs that ends where the paragraph's node
hashes to 0 modulo a power of 4 (content decides, so an insertion moves no other boundary); the power is the least that
leaves SECTIONS sections or fewer to be expected, so short texts have a section for each paragraph. A section's node is
the SHA-256 of its paragraphs' nodes and the root that of all section nodes: equal roots mean equal texts. `merkle_tree`
gives the whole tree. The fingerprint is of bounded size, whatever the text:

    root ":" section nodes, 8 hex digits each, joined by "." ":" count of distinct pieces, hexadecimal ":" sketch

Pieces are the leaves below paragraphs: runs that end after . ! ? or |, none longer than PIECE characters, so a text
without sentence ends has leaves as well. The sketch is the SKETCH smallest of their distinct hashes, 8 hex digits each.
Two fingerprints are compared from the root down: equal roots are equal texts, section nodes that differ name the places
that were edited (`differing_sections`), and the sketches give how much of the leaves is shared (`with_likeness`): the Dice
coefficient of the sets of pieces, exact where both have at most SKETCH pieces, else estimated from the smallest
SKETCH hashes of both together (standard error 0.04 or less). Where content makes more than MOST_SECTIONS sections, the smallest of
their nodes stand in the fingerprint; the root covers all.

Defined results: a null text counts as empty, and the empty text has one section of one empty paragraph without pieces;
two texts without pieces have likeness 1, one with and one without 0. Rows that share doc_id and text are one document
and get equal results; rows with one doc_id and other texts are documents of their own, ordered by their text's hash.
A null doc_id comes last. A lone document is its own next document. An empty table has no rows; other columns of docs are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import partitions_for, read, staged

PIECE, SKETCH, SECTIONS, MOST_SECTIONS = 40, 128, 16, 64
_PIECES = rf"[^.!?|\n]{{1,{PIECE}}}[.!?|]*|[.!?|]+"


def _hex8(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 8, "0")


def piece_hashes(text: Column) -> Column:
    """Distinct 32-bit hashes of the pieces."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), lambda x: F.shiftrightunsigned(F.xxhash64(x), 32)))


def paragraph_nodes(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256))


def _sections(nodes: Column) -> Column:
    """The paragraph nodes of each section, run together: array<string>."""
    # 4 ** ceil(log4(paragraphs / SECTIONS)), at least 1; repeated beside the nodes, for a lambda would compute it for each
    power = F.pow(F.lit(4.0), F.ceil(F.greatest(F.lit(0.0), F.log(F.size(nodes) / F.lit(float(SECTIONS))) / F.log(F.lit(4.0))))).cast("long")
    marked = F.zip_with(nodes, F.array_repeat(power, F.size(nodes)), lambda d, p: F.concat(d, F.when(F.pmod(F.xxhash64(d), p) == 0, "/").otherwise(".")))
    return F.filter(F.split(F.array_join(marked, ""), "/"), lambda s: s != "")


def merkle_tree(text: Column) -> Column:
    """struct(root, sections array<struct(node, paragraphs array<string>)>): the whole tree of a text, not bounded."""
    sections = F.transform(_sections(paragraph_nodes(text)), lambda s: F.struct(F.sha2(s, 256).alias("node"), F.filter(F.split(s, r"\."), lambda d: d != "").alias("paragraphs")))
    return F.struct(F.sha2(F.array_join(F.transform(sections, lambda s: s["node"]), ""), 256).alias("root"), sections.alias("sections"))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column; the steps are columns of their own, so that each is evaluated once."""
    lines, nodes, pieces = f"{name}_lines", f"{name}_nodes", f"{name}_pieces"
    df = df.withColumn(lines, paragraph_nodes(F.col(text))).withColumn(nodes, F.transform(_sections(F.col(lines)), lambda s: F.sha2(s, 256))).withColumn(pieces, piece_hashes(F.col(text)))
    shown = F.transform(F.when(F.size(nodes) <= MOST_SECTIONS, F.col(nodes)).otherwise(F.slice(F.array_sort(nodes), 1, MOST_SECTIONS)), lambda d: F.substring(d, 1, 8))
    sketch = F.transform(F.slice(F.array_sort(pieces), 1, SKETCH), _hex8)
    made = F.concat(F.sha2(F.array_join(nodes, ""), 256), F.lit(":"), F.array_join(shown, "."), F.lit(":"), F.lower(F.hex(F.size(pieces))), F.lit(":"), F.array_join(sketch, ""))
    return df.withColumn(name, made).drop(lines, nodes, pieces)


def _part(fingerprint: Column, i: int) -> Column:
    return F.split(fingerprint, ":")[i]


def _sketch(fingerprint: Column) -> Column:
    return F.regexp_extract_all(_part(fingerprint, 3), F.lit("[0-9a-f]{8}"), F.lit(0))


def _whole(fingerprint: Column) -> Column:
    """Whether the sketch holds all pieces."""
    return (F.length(_part(fingerprint, 2)) < 2) | (F.conv(_part(fingerprint, 2), 16, 10).cast("long") <= SKETCH)


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the Dice coefficient of the pieces of two texts, from their fingerprints alone. Steps are columns of their own,
    so that each is evaluated once."""
    x, y, both, shared, seen = (f"{name}_{s}" for s in ("x", "y", "both", "shared", "seen"))
    df = df.withColumn(x, _sketch(F.col(a))).withColumn(y, _sketch(F.col(b))).withColumn(both, F.array_union(x, y)).withColumn(shared, F.array_intersect(x, y))
    # hashes beyond the SKETCH smallest of both are known of neither text for sure
    df = df.withColumn(seen, F.when(_whole(F.col(a)) & _whole(F.col(b)), F.lit(None).cast("array<string>")).otherwise(F.slice(F.array_sort(both), 1, SKETCH)))
    share = F.when(F.col(seen).isNull(), F.size(shared) / F.size(both)).otherwise(F.size(F.array_intersect(shared, seen)) / F.size(seen))
    same = (_part(F.col(a), 0) == _part(F.col(b), 0)) | (F.size(both) == 0)
    return df.withColumn(name, F.when(same, F.lit(1.0)).otherwise(2 * share / (1 + share))).drop(x, y, both, shared, seen)


def differing_sections(a: Column, b: Column) -> Column:
    """Section nodes of fingerprint a that fingerprint b does not hold: where a was edited."""
    return F.when(_part(a, 0) == _part(b, 0), F.array().cast("array<string>")).otherwise(F.array_except(F.split(_part(a, 1), r"\."), F.split(_part(b, 1), r"\.")))


def next_documents(docs: DataFrame, rows_per_group: int = 200_000) -> DataFrame:
    """(doc_id, h, next_id, next_h) for each distinct (doc_id, text), in descending doc_id order, the last followed by the
    first. Only ids and hashes are sorted: in ranges, each by its own task, joined at their ends by a table of one row for
    each range."""
    slim = docs.select("doc_id", F.xxhash64("text").alias("h")).distinct()
    slim = staged(slim, "merkle-ids")
    groups = partitions_for(slim.count(), rows_per_group)
    ranged = slim.repartitionByRange(groups, F.col("doc_id").desc_nulls_last(), F.col("h")).withColumn("g", F.spark_partition_id())
    ranged = staged(ranged, "merkle-ranges")
    heads = ranged.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), "h", "doc_id")).alias("head"))
    # at most `groups` rows in one task
    heads = heads.selectExpr("g", "lead(head, 1) over (order by g) as after", "first(head) over (order by g) as top").selectExpr("g", "coalesce(after, top) as after")
    step = "over (partition by g order by doc_id desc nulls last, h)"
    linked = ranged.selectExpr("g", "doc_id", "h", f"lead(struct(doc_id, h)) {step} as nxt").join(staged(heads, "merkle-heads"), "g")
    return linked.selectExpr("doc_id", "h", "coalesce(nxt.doc_id, if(nxt is null, after.doc_id, null)) as next_id", "coalesce(nxt.h, after.h) as next_h")


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = docs.withColumn("h", F.xxhash64("text"))
    order = staged(next_documents(docs), "merkle-next")
    nulls = F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull()
    # one exchange of the texts, each with its fingerprint, serves both joins
    rows = with_fingerprint(keyed.select(nulls[0].alias("k"), nulls[1].alias("z"), "h", "text"), "text", "fingerprint")
    # a document as the next one of another: its opening and pieces go to that other
    before = order.select(F.coalesce("next_id", F.lit(0)).alias("k"), F.col("next_id").isNull().alias("z"), F.col("next_h").alias("h"), F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"))
    sizes = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).distinct()
    before = before.join(sizes.select(F.coalesce("doc_id", F.lit(0)).alias("to_k"), F.col("doc_id").isNull().alias("to_z"), F.col("h").alias("to_h2"), "n"), (F.coalesce("to_id", F.lit(0)) == F.col("to_k")) & (F.col("to_id").isNull() == F.col("to_z")) & (F.col("to_h") == F.col("to_h2")))
    before = staged(before.select("k", "z", "h", "to_k", "to_z", "to_h", F.floor(F.col("n") / 3).cast("int").alias("m")), "merkle-before")
    sent = rows.join(before, ["k", "z", "h"]).groupBy("to_k", "to_z", "to_h").agg(F.min(F.struct(F.expr("substring(text, 1, m)").alias("opening"), "fingerprint")).alias("n"))
    sent = sent.select(F.col("to_k").alias("k"), F.col("to_z").alias("z"), F.col("to_h").alias("h"), "n.opening", F.col("n.fingerprint").alias("next_fingerprint"))
    met = rows.join(sent, ["k", "z", "h"]).withColumn("n_chars", F.length("text").cast("long"))
    met = met.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.col("opening")))
    met = with_fingerprint(met, "edited", "edited_fingerprint")
    met = with_likeness(with_likeness(met, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return met.select(
        F.when(~F.col("z"), F.col("k")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op10_merkle_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(read(spark, sf_dir, "documents"))
