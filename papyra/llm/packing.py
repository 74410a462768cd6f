"""Packing token pieces into fixed-length sequences: shortest-pack-first over the length histogram.

Texts become token ids once, in a written table of pieces: whole documents where they fit, else full-length cuts and a
remainder. Only the histogram of piece lengths (at most `limit` rows) comes to the driver. Lengths are placed longest
first; each takes the shortest open packs that still leave room (worst fit), whole counts of equal packs at a time, so the work
depends on the number of lengths, not of documents. The result is a table of packing patterns with counts; pieces of a
length are ranked, in parallel, and their ranks look their sequence up.

Special tokens that are spelled in a text are encoded as the tokenizer's plain call does, as one id.

Defined results: a null or empty text is the one end id; repeated rows are pieces of their own, also with a null doc_id; an
empty table packs to nothing; other columns of docs are not read, and `pack` keeps those of pieces, whatever their names
(its own helpers take names that are free).
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from papyra.llm.common import fresh, partitions_for, read, staged

TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 1_000_000
#: Words that stay when the cache is full: short ones are the frequent ones.
STAY = 7
_PUNCTUATION = "\"#$%&()*+,-./:;!?|<=>@[\\]^_`{}~"
#: Separators of str.split() that the tokenizer's white-space pattern does not hold.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Special tokens are found as they are written, and str.lower() and the tokenizer need not agree on these letters (context,
#: several letters for one, younger scripts): texts that hold any of them are not lower-cased before they are split.
_KEEP_CASE = re.compile(r"<\||[\u0130\u03a3\u10a0-\u10ff\u1c80-\u1cbf\u1e9e\u2c00-\u2c7f\ua640-\ua7ff\uab30-\uabbf\U00010400-\U0001ffff]")
#: Letters of old scripts, which every version of Unicode knows as such and which stay single letters in lower case.
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u0451\u4e00-\u9fa5]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """The tokenizer drops white space and never joins over it, so a text's ids are those of its words in turn. Ids of
    words, as little-endian unsigned 32-bit bytes, are kept in a bounded cache.

    Unknown words of common letters are encoded many at a time as one text: such a word is one unit of the tokenizer, and a
    unit's last token marks a word end, so the ids fall apart into words again; where the count of word ends does not
    come out, and for all other words (special tokens, marks, letters with no single lower-case letter), each is encoded
    on its own. Common letters and then punctuation are two units, whose ids are put together."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = t = Tokenizer.from_file(path)
        self.ends = np.zeros(t.get_vocab_size(), bool)
        for piece, i in t.get_vocab(with_added_tokens=True).items():
            self.ends[i] = piece.endswith("</w>")
        self.cache: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words) or at[-1] != len(ids):
            return self._each(words)
        cuts = [0, *(4 * at).tolist()]
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def learn(self, new: list[str]) -> None:
        """Puts new words into the cache."""
        plain, other, two = set(), set(), []
        for w in new:
            if _LETTERS.fullmatch(w):
                plain.add(w)
            elif "<|" not in w and (base := w.rstrip(_PUNCTUATION)) and _LETTERS.fullmatch(base):
                two.append((w, base, w[len(base) :]))
            else:
                other.add(w)
        for _, base, tail in two:
            if base not in self.cache:
                plain.add(base)
            if tail not in self.cache:
                other.add(tail)
        letters = list(plain)
        for i in range(0, len(letters), 2000):
            self.cache.update(zip(letters[i : i + 2000], self._together(letters[i : i + 2000]), strict=True))
        rest = list(other)
        if rest:
            self.cache.update(zip(rest, self._each(rest), strict=True))
        self.cache.update((w, self.cache[base] + self.cache[tail]) for w, base, tail in two)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [None if not t else [t] if any(c in t for c in _NOT_SPACE) else t.split() if _KEEP_CASE.search(t) else t.lower().split() for t in texts]
        new: set[str] = set()
        for ws in split:
            if ws:
                new.update(ws)
        missing = list(new.difference(self.cache))
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache = {w: b for w, b in self.cache.items() if len(w) <= STAY}
            if 2 * len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            missing = list(new.difference(self.cache))
        self.learn(missing)
        get = self.cache.__getitem__
        out = [b"".join(map(get, ws)) if ws else b"" for ws in split]
        for ws in split:  # texts that stand whole in the cache, and giant words, are not kept
            if ws and len(ws) == 1 and len(ws[0]) > 100:
                self.cache.pop(ws[0], None)
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _batches(texts: list[str | None], chars: int = 2_000_000) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _pieces(path: str, limit: int, end_id: int, digest: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(path)
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for part in _batches(texts):
                out = []
                for doc_id, b in zip(ids[part], words.encode(texts[part]), strict=True):
                    b += end
                    n = len(b) // 4
                    for s in range(0, n, limit):
                        piece = b[4 * s : 4 * (s + limit)]
                        out.append((doc_id, s, min(limit, n - s), n, zlib.crc32(piece) if digest else piece))
                yield pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "ids_crc32" if digest else "ids"]).astype({"doc_id": "Int64"})

    return run


def token_pieces(docs: DataFrame, limit: int = 2048, end_id: int = 1, path: str | None = None, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit) or, as a digest, their
    ids_crc32; the end id is counted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    last = "ids_crc32 long" if digest else "ids binary"
    return docs.mapInPandas(_pieces(path or tokenizer_path(), limit, end_id, digest), f"doc_id long, start long, length long, doc_tokens long, {last}")


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a pack, how many such packs)]. Lengths go longest first; a length is added to the packs with the most
    room left (the shortest), as many at a time as there are of them."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted keys of open_packs

    def put(room: int, pack: tuple[int, ...], count: int) -> None:
        if room not in open_packs:
            open_packs[room] = []
            bisect.insort(rooms, room)
        open_packs[room].append((pack, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= limit:
            raise ValueError(f"length {length} is outside 1 to {limit}")
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pack, count = open_packs[room].pop()
                if not open_packs[room]:
                    del open_packs[room]
                    rooms.pop()
                fit = max(1, min(room // length, -(-left // count)))  # equal pieces go into one pack while they fit
                use = min(count, left // fit)
                put(room - fit * length, (*pack, *[length] * fit), use)
                if count > use:
                    put(room, pack, count - use)
                left -= use * fit
            else:
                fit = min(limit // length, left)
                use = left // fit
                put(limit - fit * length, (length,) * fit, use)
                left -= use * fit
    return [x for room in rooms for x in open_packs[room]]


def _lookup(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """For each run of equal lengths in a pattern: (length, first rank, ranks, first sequence, offset, in a pack)."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for pack, count in patterns:
        offset, i = 0, 0
        while i < len(pack):
            j = i
            while j < len(pack) and pack[j] == pack[i]:
                j += 1
            first = ranks.get(pack[i], 0)
            out.append((pack[i], first, first + (j - i) * count, sequence, offset, j - i))
            ranks[pack[i]] = first + (j - i) * count
            offset += (j - i) * pack[i]
            i = j
        sequence += count
    return out


def pack(spark: SparkSession, pieces: DataFrame, limit: int = 2048, rows_per_group: int = 2_000) -> DataFrame:
    """pieces (length, ...) -> the same rows with sequence_id and offset. pieces must be a stable table (written)."""
    cell, key, rank, first, p_length, runs, hit = fresh(pieces, "cell", "key", "rank", "first", "p_length", "runs", "hit")
    total = pieces.count()
    cells = partitions_for(total, rows_per_group)
    # ranks within a length: a length may hold any share of the rows, so it is dealt into cells with known offsets
    order = [F.col(c) for c in pieces.columns if c not in ("ids", "text")]
    ranked = pieces.withColumn(key, F.xxhash64(*order)).withColumn(cell, F.pmod(F.col(key), F.lit(cells)).cast("int"))
    sizes = staged(ranked.groupBy("length", cell).count(), "pack-sizes")
    histogram = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("count")).collect()}  # at most limit rows
    patterns = shortest_pack_first(histogram, limit)
    table = spark.createDataFrame(_lookup(patterns), "p_length long, p_first long, p_end long, p_sequence long, p_offset long, p_in long")
    starts = sizes.selectExpr("length", f"`{cell}`", f"sum(count) over (partition by length order by `{cell}`) - count as `{first}`")
    local = F.expr(f"row_number() over (partition by length, `{cell}` order by `{key}`, {', '.join(f'`{c}`' for c in pieces.columns if c not in ('ids', 'text'))})")
    placed = ranked.withColumn(rank, local).join(starts, ["length", cell]).withColumn(rank, F.col(rank) - 1 + F.col(first))
    # patterns depend on lengths alone: a few for each, so the table is small whatever the number of pieces
    bounds = table.groupBy(F.col("p_length").alias(p_length)).agg(F.sort_array(F.collect_list(F.struct("p_end", "p_first", "p_sequence", "p_offset", "p_in"))).alias(runs))
    found = placed.join(F.broadcast(bounds), F.col("length") == F.col(p_length))
    found = found.withColumn(hit, F.col(runs)[F.size(F.filter(runs, lambda r: r["p_end"] <= F.col(rank)))])
    within = F.col(rank) - F.col(f"{hit}.p_first")
    sequence_id, offset = fresh(pieces, "sequence_id", "offset")
    return found.select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (F.col(f"{hit}.p_sequence") + F.floor(within / F.col(f"{hit}.p_in"))).cast("long").alias(sequence_id),
        (F.col(f"{hit}.p_offset") + F.pmod(within, F.col(f"{hit}.p_in")) * F.col("length")).cast("long").alias(offset),
    )


def packed_documents(docs: DataFrame, limit: int = 2048) -> DataFrame:
    """Pieces of all documents with their place and a digest of their ids, without the ids (packed_sequences has them)."""
    return pack(docs.sparkSession, staged(token_pieces(docs, limit, digest=True), "pack-pieces"), limit)


def packed_sequences(docs: DataFrame, limit: int = 2048) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, unpadded; at most limit ids each."""
    pieces = staged(token_pieces(docs, limit), "pack-pieces")
    rows = pack(docs.sparkSession, pieces, limit)
    return rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op4_shortest_pack_first(spark, sf_dir: str) -> DataFrame:
    out = packed_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
