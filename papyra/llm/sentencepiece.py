"""SentencePiece encoding and decoding with a parallel scan over chunks of giant documents.

The model file is of the BPE kind: its ids are not the best sum of piece scores but the result of ranked merges. That
result is still the one path of weight 0 in a lattice: a path of pieces is the BPE segmentation of its text exactly if
every two neighbours are the BPE segmentation of their own concatenation (merges are local and ranks are distinct). So
edges between neighbours weigh 0 where that holds and minus infinity elsewhere, and the max-plus machinery applies:

 1. a document of more than chunk_chars characters is cut at fixed places into chunks (rows of their own);
 2. the boundary states at a cut are the pieces that could lie across or end at it; each chunk alone computes its matrix
    of weights (0 or minus infinity) from the states at its left cut to those at its right one. Inside a chunk all states
    meet at the first word start, so the scan is over a few characters at each end; a run without word starts is scanned
    whole, states that have met going on as one;
 3. the matrices of a document are multiplied in (max, +), an associative product, in a tree: FAN neighbours at a time give
    the matrix of their span, level by level, until FAN spans or fewer are left. From the top down, each span's two states
    then fix the states at the cuts inside it. No task holds more than FAN matrices, however long the document;
 4. every chunk is then traced on its own between its two states.

No piece reaches over a word start or a line feed, so what lies between the first and the last word start of a chunk is
segmented by the library itself; short documents are chunks with both states known.

Output rows are chunks (chunk_no from 0) of rows (rid, a number of their own), so that no giant id list has to be held in
one row. Defined results: a null or empty text has one chunk with no ids; repeated rows and ids, null ones too, are encoded
each on its own; an empty table has no rows; other columns of docs are not read; decoding joins the chunks' pieces and
drops the one space that encoding puts before a text. A U+2581 in a text is a space to the model and comes back as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import read, staged

MODEL = "piece_bpe_32k.model"
CHUNK = 1 << 15
CACHE_PAIRS = 300_000
#: Neighbouring matrices that one task multiplies.
FAN = 64
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """Vocabulary, ranks and pair rule of a SentencePiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str) -> None:
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
        self.longest = max(map(len, self.ids))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and p != "\n") for p in self.ids):
            raise ValueError("pieces of this model reach over word starts")
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Ranked merges over a short string: the best-scored neighbours first, the left ones on a tie."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.merge(a + b) == [a, b]
        return ok

    def steps(self, text: str, i: int) -> Iterator[str]:
        """Pieces that begin at i: those of the vocabulary that are a segmentation of themselves, and a single character."""
        for n in range(1, min(self.longest, len(text) - i) + 1):
            s = text[i : i + n]
            if n == 1 or s in self.ids:
                yield s

    def piece_ids(self, s: str) -> list[int]:
        i = self.ids.get(s)
        return [i] if i is not None else [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]

    def segment(self, w: str) -> list[str]:
        """Pieces of a long word by the lattice, in time in proportion to its length."""
        last: dict[int, str] = {0: ""}
        for i in range(len(w)):
            if i in last:
                for s in self.steps(w, i):
                    if i + len(s) not in last and (not last[i] or self.follows(last[i], s)):
                        last[i + len(s)] = s
        out, i = [], len(w)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


_START = re.compile(f"(?<=[^{SPACE}]){SPACE}|(?<=\n)[^{SPACE}]|\n")


def ids_between_words(m: Bpe, text: str) -> bytes:
    """text: normalised, beginning and ending at word starts. The library puts a space before a text, which is taken for
    the text's own, or, where it has none, kept apart by a line feed."""
    if text[:1] == SPACE:
        ids = m.sp.encode(text[1:])
    else:
        ids = m.sp.encode("\n" + text)[2:]
    return np.array(ids, "<i4").tobytes()


def states_at(m: Bpe, text: str, cut: int) -> list[tuple[int, str]]:
    """(end, piece) of the pieces that begin before the cut and end at it or later."""
    out = []
    for a in range(max(0, cut - m.longest), cut):
        for s in m.steps(text, a):
            if a + len(s) >= cut:
                out.append((a + len(s), s))
    return out


def scan(m: Bpe, text: str, left: int, right: int, entries: list[tuple[int, str]]) -> dict[tuple[int, str], int]:
    """States at the right cut -> bit set of the entries (states at the left cut) from which a path of weight 0 leads
    there. text reaches m.longest characters beyond both cuts, or to its end."""
    live: dict[int, dict[str, int]] = {}
    out: dict[tuple[int, str], int] = {}

    def put(end: int, piece: str, bits: int) -> None:
        if end >= right:
            out[(end, piece)] = out.get((end, piece), 0) | bits
        else:
            at = live.setdefault(end, {})
            at[piece] = at.get(piece, 0) | bits

    for k, (end, piece) in enumerate(entries):
        put(end, piece, 1 << k)
    i = left
    while live:
        i = min(live)
        at = live.pop(i)
        if i < right:
            if len(at) >= 1 and not live and _START.match(text, i) and i > left:
                # a word start: all paths meet, and all that follows is the same for them
                bits = 0
                for b in at.values():
                    bits |= b
                last = max((x.start() for x in _START.finditer(text, i, right)), default=i)
                if last > i:
                    put(last, _last_piece(m, text, i, last), bits)
                    continue
                at = {next(iter(at)): bits} if len(at) == 1 else at
            for s in m.steps(text, i):
                bits = 0
                for piece, b in at.items():
                    if not piece or m.follows(piece, s):
                        bits |= b
                if bits:
                    put(i + len(s), s, bits)
    return out


def _last_piece(m: Bpe, text: str, i: int, end: int) -> str:
    """Last piece of the segmentation of text[i:end], both word starts."""
    a = max((x.start() for x in _START.finditer(text, i, end)), default=i)
    w = text[max(i, a) : end]
    return (m.merge(w) if len(w) <= 200 else m.segment(w))[-1]


def trace(m: Bpe, text: str, left: int, right: int, entry: tuple[int, str], leave: tuple[int, str] | None) -> bytes:
    """Ids of the pieces after the entry state up to and with the leaving state."""
    i, before = entry
    end = leave[0] if leave else right
    starts = [x.start() for x in _START.finditer(text, i, right)] if i < right else []
    if not starts or i >= right:
        return _trace_run(m, text, i, end, before)
    first, last = starts[0], starts[-1]
    head = _trace_run(m, text, i, first, before) if first > i else b""
    tail_from = last
    middle = ids_between_words(m, text[first:tail_from]) if tail_from > first else b""
    return head + middle + _trace_run(m, text, tail_from, end, "")


def _trace_run(m: Bpe, text: str, i: int, end: int, before: str) -> bytes:
    if i >= end:
        return b""
    last: dict[int, str] = {i: before}
    for a in range(i, end):
        if a in last:
            for s in m.steps(text[:end], a):
                if a + len(s) not in last and (not last[a] or m.follows(last[a], s)):
                    last[a + len(s)] = s
    out, a = [], end
    while a > i:
        out.append(last[a])
        a -= len(last[a])
    return np.array([x for s in out[::-1] for x in m.piece_ids(s)], "<i4").tobytes()


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def _whole(path: str):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = bpe(path)
        for batch in texts:
            yield pd.Series([ids_between_words(m, normalised(t)) if t else b"" for t in batch], dtype=object)

    return F.pandas_udf(run, "binary")


def _matrices(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = bpe(path)
        for pdf in batches:
            out = []
            for t, left, size, first, final in zip(pdf["part"], pdf["left"], pdf["size"], pdf["first"], pdf["final"], strict=True):
                t = normalised(t)[0 if first else 1 :]
                left, right = (0, size + 1) if first else (left, left + size)
                entries = [(0, "")] if first else states_at(m, t, left)
                found = scan(m, t, left, right, entries)
                rows = [(e - right, s, [k for k in range(len(entries)) if bits >> k & 1]) for (e, s), bits in found.items() if not final or e == right]
                out.append(([e - left for e, _ in entries], [s for _, s in entries], [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
            yield pd.concat([pdf[["rid", "chunk_no"]].reset_index(drop=True), pd.DataFrame(out, columns=["in_at", "in_piece", "out_at", "out_piece", "from_in"])], axis=1)

    return run


State = tuple[int, str]
Matrix = tuple[list[State], list[State], list[list[int]]]  # states at the left and right cut; entries of each right one


def product(a: Matrix, b: Matrix) -> Matrix:
    """(max, +) product of the matrices of two neighbouring spans; the weights are 0 (listed) and minus infinity."""
    rows = {state: set(sources) for state, sources in zip(a[1], a[2], strict=True)}
    through = [rows.get(state, set()) for state in b[0]]
    merged = [sorted(set().union(*(through[k] for k in sources))) for sources in b[2]]
    keep = [i for i, sources in enumerate(merged) if sources]
    return a[0], [b[1][i] for i in keep], [merged[i] for i in keep]


def span(matrices: list[Matrix]) -> Matrix:
    """Product of neighbours in pairs, then of the pairs, and so on."""
    while len(matrices) > 1:
        pairs = [product(x, y) for x, y in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[len(matrices) - len(matrices) % 2 :]
    return matrices[0]


def combine(rows: list[Matrix], entry: State = (0, ""), leave: State | None = None) -> list[tuple[State, State]]:
    """The states at both cuts of each of some neighbouring spans, given those at the outer cuts (by default of a whole
    document: reachable states go forward from the entry, then the one path is taken back from the end)."""
    alive = [{entry}]
    for ins, outs, sources in rows:
        here = {k for k, s in enumerate(ins) if s in alive[-1]}
        alive.append({o for o, src in zip(outs, sources, strict=True) if here.intersection(src)})
    if not alive[-1] or (leave is not None and leave not in alive[-1]):
        raise RuntimeError("no path through the chunks")
    state = min(alive[-1]) if leave is None else leave
    back = [state]
    for (ins, outs, sources), before in zip(reversed(rows), reversed(alive[:-1]), strict=True):
        src = sources[outs.index(state)]
        state = next(ins[k] for k in src if ins[k] in before)
        back.append(state)
    back.reverse()
    return list(zip(back[:-1], back[1:], strict=True))


def _read_matrices(pdf: pd.DataFrame) -> list[Matrix]:
    return [(list(zip(a, b, strict=True)), list(zip(c, d, strict=True)), [list(x) for x in e]) for a, b, c, d, e in zip(pdf["in_at"], pdf["in_piece"], pdf["out_at"], pdf["out_piece"], pdf["from_in"], strict=True)]


def _span(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk_no")
    ins, outs, sources = span(_read_matrices(pdf))
    return pd.DataFrame([(pdf["rid"].iloc[0], pdf["grp"].iloc[0], [a for a, _ in ins], [b for _, b in ins], [a for a, _ in outs], [b for _, b in outs], sources)], columns=["rid", "chunk_no", "in_at", "in_piece", "out_at", "out_piece", "from_in"])


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk_no")
    known = [(pdf["e_at"].iloc[0], pdf["e_piece"].iloc[0]), (pdf["l_at"].iloc[0], pdf["l_piece"].iloc[0])] if "e_at" in pdf else []
    got = combine(_read_matrices(pdf), *known)
    return pd.DataFrame({"rid": pdf["rid"].to_numpy(), "chunk_no": pdf["chunk_no"].to_numpy(), "e_at": [a[0] for a, _ in got], "e_piece": [a[1] for a, _ in got], "l_at": [b[0] for _, b in got], "l_piece": [b[1] for _, b in got]})


_MATRIX = "rid long, chunk_no int, in_at array<int>, in_piece array<string>, out_at array<int>, out_piece array<string>, from_in array<array<int>>"
_STATES = "rid long, chunk_no int, e_at int, e_piece string, l_at int, l_piece string"


def boundary_states(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """matrices of chunks, a written table -> the states at both cuts of each chunk. The tree has log(chunks) / log(fan) levels."""
    most, levels = matrices.agg(F.max("chunk_no")).first()[0] or 0, [matrices]
    group = F.floor(F.col("chunk_no") / fan).cast("int")
    while most >= fan:
        up = levels[-1].withColumn("grp", group).groupBy("rid", "grp").applyInPandas(_span, _MATRIX)
        levels.append(staged(up, "pieces-spans"))
        most //= fan
    states = levels.pop().groupBy("rid").applyInPandas(_combine, _STATES)  # at most fan rows of each document
    while levels:
        known = states.withColumnRenamed("chunk_no", "grp")
        states = levels.pop().withColumn("grp", group).join(known, ["rid", "grp"]).groupBy("rid", "grp").applyInPandas(_combine, _STATES)
    return states


def _trace(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = bpe(path)
        for pdf in batches:
            out = []
            for t, left, size, first, ea, ep, la, lp in zip(pdf["part"], pdf["left"], pdf["size"], pdf["first"], pdf["e_at"], pdf["e_piece"], pdf["l_at"], pdf["l_piece"], strict=True):
                t = normalised(t)[0 if first else 1 :]
                left, right = (0, size + 1) if first else (left, left + size)
                out.append(trace(m, t, left, right, (left + ea, ep), (right + la, lp)))
            yield pdf[["rid", "doc_id", "chunk_no"]].assign(ids=out)

    return run


def encoded(docs: DataFrame, chunk_chars: int = CHUNK, path: str | None = None, fan: int = FAN) -> DataFrame:
    """docs (doc_id, text) -> doc_id, rid (one number for each row of docs), chunk_no, ids (little-endian 32-bit)."""
    path = path or model_path()
    reach = bpe(path).longest
    if chunk_chars < 4 * reach:
        raise ValueError(f"chunk_chars must be at least {4 * reach}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = docs.where(F.length("text") <= chunk_chars).select("doc_id", F.monotonically_increasing_id().alias("rid"), F.lit(0).alias("chunk_no"), _whole(path)("text").alias("ids"))
    giant = docs.where(F.length("text") > chunk_chars).withColumn("rid", -1 - F.monotonically_increasing_id()).withColumn("n", F.length("text"))
    parts = giant.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk_chars).cast("int"))))
    start = F.greatest(F.lit(0), F.col("chunk_no") * chunk_chars - reach)
    parts = parts.select(
        "rid", "doc_id", "chunk_no",
        F.col("text").substr(start + 1, F.lit(chunk_chars + 2 * reach)).alias("part"),
        (F.col("chunk_no") * chunk_chars - start).alias("left"),
        F.least(F.lit(chunk_chars), F.col("n") - F.col("chunk_no") * chunk_chars).cast("int").alias("size"),
        (F.col("chunk_no") == 0).alias("first"),
        ((F.col("chunk_no") + 1) * chunk_chars >= F.col("n")).alias("final"),
    )
    parts = staged(parts.repartition("rid", "chunk_no"), "pieces-chunks")
    matrices = parts.select("rid", "chunk_no", "part", "left", "size", "first", "final").mapInPandas(_matrices(path), _MATRIX)
    states = boundary_states(staged(matrices, "pieces-matrices"), fan)
    traced = parts.join(states, ["rid", "chunk_no"]).mapInPandas(_trace(path), "rid long, doc_id long, chunk_no int, ids binary")
    return short.select("doc_id", "rid", "chunk_no", "ids").union(traced.select("doc_id", "rid", "chunk_no", "ids"))


class _Texts:
    def __init__(self, m: Bpe) -> None:
        n = m.sp.vocab_size()
        self.bytes = [b""] * n
        for piece, i in m.ids.items():
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        for b, i in m.bytes.items():
            self.bytes[i] = bytes([b])


@lru_cache(maxsize=2)
def _texts(path: str) -> _Texts:
    return _Texts(bpe(path))


def decode_bytes(ids: bytes, path: str, first: bool = True) -> bytes:
    """Bytes of one chunk's pieces; the space before the text is dropped from the first chunk."""
    out = b"".join(map(_texts(path).bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))
    return out[1:] if first and out[:1] == b" " else out


def _decode(path: str):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, no in batches:
            yield pd.Series([decode_bytes(i, path, n == 0) for i, n in zip(ids, no, strict=True)], dtype=object)

    return F.pandas_udf(run, "binary")


def decoded(chunks: DataFrame, path: str | None = None) -> DataFrame:
    """chunks (chunk_no, ids, ...) with `decoded`: the UTF-8 bytes of each chunk (a character may lie over two of them)."""
    return chunks.withColumn("decoded", _decode(path or model_path())("ids", "chunk_no"))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = decoded(encoded(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "rid", "chunk_no", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), "ids", F.crc32("ids").alias("ids_crc32"), F.octet_length("decoded").cast("long").alias("decoded_bytes"), F.crc32("decoded").alias("decoded_crc32"))
