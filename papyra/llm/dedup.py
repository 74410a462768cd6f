"""Near-duplicate classes by b-bit MinHash.

One pass turns each text into its set of word shingles and H full minima. The minima make band keys (candidate
generation); only the low b bits of each minimum are kept, packed into longs, and pairs that share a band are first
judged by the bit counts of their packed signatures, corrected for chance collisions. Pairs that could reach the
threshold are confirmed on the full sets, so no false link is made.

No pair list of a bucket is ever made: equal sets are folded into one representative first, then every member of a
bucket is tested against the bucket's smallest member, links are closed into components, and only buckets that still
hold several components are looked at again, with other centres, and at last in blocks of packed signatures.

Defined results: a null, empty or white-space-only text has an empty set, n_shingles 0, and is alone in its class;
repeated rows of one id form one row each with the same class; ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import pieces, staged

M64 = (1 << 64) - 1
#: Bucket members, and shingles of theirs, in one block of the last, exact step: what bounds a task's memory.
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000
CACHE_WORDS = 300_000


@dataclass(frozen=True)
class MinHash:
    """words: shingle length. percent: links need 100 * intersection >= percent * union. A pair at the threshold shares no
    band with probability (1 - (percent/100)**rows)**bands, 4e-7 for the defaults at 80. sigmas: a candidate is dropped
    unconfirmed only if its corrected estimate lies so many standard errors below the threshold."""

    words: int = 2
    percent: int = 80
    bands: int = 28
    rows: int = 4
    bits: int = 4
    sigmas: float = 5.5
    seed: int = 20240607

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        return -(-self.hashes * self.bits // 64)

    @property
    def most_mismatches(self) -> int:
        """Of two signatures, with collision correction: P(equal low bits) = s + (1 - s) / 2**bits."""
        p = self.percent / 100 + (1 - self.percent / 100) / 2**self.bits
        return int(np.ceil(self.hashes * (1 - p) + self.sigmas * np.sqrt(self.hashes * p * (1 - p))))


def corrected_similarity(mismatches: float, hashes: int, bits: int) -> float:
    """Jaccard estimate from the count of differing b-bit minima."""
    chance = 1 / 2**bits
    return max(0.0, ((1 - mismatches / hashes) - chance) / (1 - chance))


class _Words(dict):
    """word -> 64-bit hash; emptied when full, so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes: A-Z lower-cased, words are runs of bytes that are not ASCII white space;
    a text with fewer words than a shingle gives its whole sequence as one."""
    cache, parts = _words(), []
    for piece in pieces(text or ""):
        found = piece.encode("utf-8", "surrogatepass").lower().split()
        parts.append(np.fromiter((cache[w] for w in found), np.uint64, len(found)))
    h = np.concatenate(parts)
    if not len(h):
        return np.empty(0, np.uint64)
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    if k < words:
        out = _mix(out + np.uint64(k))
    return np.unique(out)


@lru_cache(maxsize=4)
def _multipliers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, M64, n, np.uint64, endpoint=True) | np.uint64(1)


def minima(sets: np.ndarray, p: MinHash) -> np.ndarray:
    a = _multipliers(p.seed, p.hashes)
    low = np.full(p.hashes, M64, np.uint64)
    for i in range(0, len(sets), 2048):
        np.minimum(low, np.multiply.outer(sets[i : i + 2048], a).min(axis=0), out=low)
    return low


def packed(low: np.ndarray, p: MinHash) -> np.ndarray:
    """Low bits of each minimum, packed into 64-bit words. The minima are mixed first: low bits of a product of odd
    numbers are not spread well."""
    per = 64 // p.bits
    v = np.zeros(p.longs * per, np.uint64)
    v[: p.hashes] = _mix(low) & np.uint64((1 << p.bits) - 1)
    shifts = (np.arange(per, dtype=np.uint64) * np.uint64(p.bits))[None, :]
    return np.bitwise_or.reduce(v.reshape(p.longs, per) << shifts, axis=1)


def band_keys(low: np.ndarray, p: MinHash) -> np.ndarray:
    b = np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for r in range(p.rows):
        b = _mix(b * np.uint64(0x9E3779B97F4A7C15) + low.reshape(p.bands, p.rows)[:, r])
    return b


def _signatures(p: MinHash):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, key, bands, sig = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, p.words)
                n.append(len(s))
                if len(s):
                    low = minima(s, p)
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(low, p).view(np.int64))
                    sig.append(packed(low, p).view(np.int64))
                else:
                    key.append(None), bands.append(None), sig.append(None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": np.array(n, np.int64), "set_key": key, "bands": bands, "sig": sig})

    return run


def _confirm(p: MinHash):
    """Pairs on full sets. Rows come sorted by centre, so a centre's set is made once for a run of its members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, np.empty(0, np.uint64)
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["text_a"], pdf["text_b"], strict=True):
                if x != last:
                    last, mine = x, shingle_set(x, p.words)
                b = shingle_set(y, p.words)
                both = len(np.intersect1d(mine, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= p.percent * (len(mine) + len(b) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _mismatches(a: str, b: str, p: MinHash):
    """Count of differing low-bit groups, on packed longs."""
    mask = int("".join("1".rjust(p.bits, "0") for _ in range(64 // p.bits)), 2)
    mask -= (mask >> 63) << 64
    total = None
    for i in range(p.longs):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        y = x
        for s in range(1, p.bits):
            y = y.bitwiseOR(F.shiftrightunsigned(x, s))
        one = F.bit_count(y.bitwiseAND(F.lit(mask)))
        total = one if total is None else total + one
    return total


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, p: MinHash, name: str) -> DataFrame:
    """pairs (a: centre, b: member, distinct) that hold on the full sets. A centre may have any number of members: its
    members are dealt into groups of 512 or so, and its text is copied once for each group."""
    sig = reps.select("rep", "sig", F.col("n_shingles").alias("n"))
    likely = (
        pairs.join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b")), "b")
        .join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a")), "a")
        .where(100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b"))
        .where(_mismatches("sig_a", "sig_b", p) <= p.most_mismatches)
        .select("a", "b")
    )
    likely = staged(likely, f"{name}-likely")
    fans = staged(likely.groupBy("a").agg((F.count("*") / 512 + 1).cast("long").alias("fans")), f"{name}-fans")
    centres = (
        fans.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        .withColumn("fan", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fans") - 1)))
        .select("a", "fan", "text_a")
    )
    members = (
        likely.join(fans, "a")
        .withColumn("fan", F.pmod(F.xxhash64("b"), F.col("fans")))
        .select("a", "b", "fan")
        .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    )
    return members.join(centres, ["a", "fan"]).select("a", "b", "text_a", "text_b").mapInPandas(_confirm(p), "a long, b long")


def components(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(node, label): smallest node reachable over links (a, b). In each round labels are lowered over links, pushed to the
    node that was the label before (roots are hooked on, so that whole trees join, however the ids lie) and jumped through
    (label of the label), until nothing changes; every round is a written table."""
    both = staged(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), f"{name}-labels")
    changed = True
    while changed:
        low = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
            .groupBy("a")
            .agg(F.min("near").alias("near"))
            .join(labels, F.col("a") == F.col("node"))
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        low = staged(low, f"{name}-low")
        pushed = low.select(F.col("old").alias("node"), F.lit(None).cast("long").alias("old"), "label")
        hooked = staged(low.union(pushed).groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("label")), f"{name}-hooked")
        up = hooked.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        after = hooked.join(up, F.col("label") == F.col("up"), "left").select("node", "old", F.least("label", F.coalesce("up_label", "label")).alias("label"))
        after = staged(after, f"{name}-labels")
        changed = not after.where("label <> old").isEmpty()
        labels = after.select("node", "label")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _block_links(p: MinHash):
    """Confirmed links in one pair of blocks of one bucket, as a forest: pairs of different components that the signatures
    allow are compared on their full sets, in the first bucket that both share, until they are of one component. Shingles are
    numbered within the task, so that a set is compared with all its candidates in a few array operations."""
    mask = np.uint64(int("".join("1".rjust(p.bits, "0") for _ in range(64 // p.bits)), 2))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, blk, text = pdf["rep"].to_numpy(), pdf["blk"].to_numpy(), pdf["text"]
        sig, bands = np.stack(pdf["sig"].to_numpy()).view(np.uint64), np.stack(pdf["bands"].to_numpy())
        i, j, band = pdf["i"].iloc[0], pdf["j"].iloc[0], pdf["band"].iloc[0]
        right, out = np.flatnonzero(blk == j), []
        part = pdf["label"].to_numpy().copy()  # component of each row, as links are found
        likely: list[tuple[int, np.ndarray]] = []
        for x in np.flatnonzero(blk == i).tolist():
            y = right[(part[right] != part[x]) & ((rep[right] > rep[x]) if i == j else True)]
            d = sig[y] ^ sig[x]
            e = d.copy()
            for s in range(1, p.bits):
                e |= d >> np.uint64(s)
            y = y[np.bitwise_count(e & mask).sum(axis=1) <= p.most_mismatches]
            same = bands[y] == bands[x]
            y = y[bands[x][same.argmax(axis=1)] == band] if len(y) else y
            if len(y):
                likely.append((x, y.astype(np.int32)))

        used = np.unique(np.concatenate([np.r_[x, y] for x, y in likely])).tolist() if likely else []
        sets = [shingle_set(text.iat[k], p.words) for k in used]
        size, start = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        size[used] = [len(s) for s in sets]
        start[used] = np.cumsum(size[used]) - size[used]
        number = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32) if sets else np.empty(0, np.int32)
        del sets
        mine = np.zeros(len(number), bool)
        for x, y in likely:
            y = y[(part[y] != part[x]) & (100 * np.minimum(size[y], size[x]) >= p.percent * np.maximum(size[y], size[x])) & (size[y] > 0)]
            if not len(y):
                continue
            own = number[start[x] : start[x] + size[x]]
            mine[own] = True
            ends = np.cumsum(size[y])
            at = np.arange(ends[-1]) + np.repeat(start[y] - ends + size[y], size[y])
            both = np.add.reduceat(mine[number[at]], ends - size[y], dtype=np.int64)
            mine[own] = False
            for k in y[100 * both >= p.percent * (size[x] + size[y] - both)].tolist():
                if part[k] != part[x]:
                    m, n = sorted((part[x], part[k]))
                    part[part == n] = m
                    out.append((min(rep[x], rep[k]), max(rep[x], rep[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """docs (doc_id long, text string, ...) -> doc_id, n_shingles, component_id, kept: one row for each row of docs.

    An id that comes with several texts is one node that has the links of each. A null doc_id stays alone, with a null
    component_id and kept true."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = staged(docs.mapInPandas(_signatures(p), "doc_id long, n_shingles long, set_key binary, bands array<long>, sig array<long>"), "minhash")
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    folded = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sig")).alias("m"))
    reps = staged(folded.select("set_key", F.col("m.doc_id").alias("rep"), "m.n_shingles", "m.bands", "m.sig"), "minhash-reps")

    buckets = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    centres = staged(buckets.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("far")).where("far > centre").select("band", "centre"), "minhash-centres")
    shared = staged(buckets.join(centres, "band").select("band", "rep", "n", "centre"), "minhash-shared")
    candidates = staged(shared.select("rep").distinct(), "minhash-candidates")
    texts = docs.withColumnRenamed("doc_id", "rep").join(candidates, "rep", "left_semi").dropDuplicates(["rep", "text"])
    texts = staged(texts, "minhash-texts")
    pairs = shared.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = staged(_links(pairs, reps, texts, p, "minhash-star"), "minhash-links")
    labels = staged(components(candidates.select(F.col("rep").alias("node")), links, "minhash-cc"), "minhash-node-labels")

    for turn in range(3):
        split = _split_buckets(shared, labels)
        if split.isEmpty():
            break
        if turn < 2:  # other centres: one member of each bucket, taken from outside the bucket's smallest component
            pick = split.where("label <> low").groupBy("band").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "label")).alias("m")).select("band", F.col("m.rep").alias("a"), F.col("m.label").alias("own"))
            pairs = split.join(staged(pick, "minhash-pick"), "band").where("label <> own").select("a", F.col("rep").alias("b")).distinct()
            more = _links(pairs, reps, texts, p, f"minhash-more{turn}")
        else:
            more = _exact_rest(split, reps, texts, p)
        more = staged(more, "minhash-more")
        if not more.isEmpty():
            links = links.union(more)
            labels = staged(components(candidates.select(F.col("rep").alias("node")), links, "minhash-cc"), "minhash-node-labels")

    by_set = reps.select(F.col("set_key").alias("of"), "rep").join(labels, F.col("rep") == F.col("node"), "left").select("of", F.coalesce("label", "rep").alias("label"))
    out = sigs.select("doc_id", "n_shingles", "set_key").join(by_set, F.col("set_key") == F.col("of"), "left")
    label = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", label.alias("component_id"), F.coalesce(label == F.col("doc_id"), F.lit(True)).alias("kept"))


def _split_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, rep, label, low, members, shingles): members of the buckets that hold more than one component."""
    now = shared.join(labels, F.col("rep") == F.col("node")).select("band", "rep", "n", "label")
    several = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), F.sum("n").alias("shingles")).where("low < high").select("band", "low", "members", "shingles")
    return staged(now.join(staged(several, "minhash-several"), "band"), "minhash-split")


def _exact_rest(split: DataFrame, reps: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """Links between the components left in a bucket. The bucket is cut into blocks and every pair of blocks is a task's
    work: pairs are compared there and never emitted, only the links that join components are. A bucket of m members
    takes (m / BLOCK)**2 / 2 pairs of blocks or more, so the work of such buckets, but not what they emit, is quadratic."""
    wide = split.withColumn("n_blk", (F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES) + 1).cast("int")).withColumn("blk", F.pmod(F.xxhash64("rep", F.lit("blk")), F.col("n_blk")).cast("int"))
    dealt = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1))).select("band", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "rep", "label")
    rows = dealt.join(reps.select("rep", "sig", "bands"), "rep").join(texts, "rep")
    return rows.groupBy("band", "i", "j").applyInPandas(_block_links(p), "a long, b long").distinct()


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    from papyra.llm.common import read

    return near_duplicates(read(spark, sf_dir, "documents"), MinHash(words=2, percent=80))
