"""Evidence of one request: greedy choice under growing penalties, windows around hits, passages with their context.

Everything here works on one text, one hit with its neighbours or one request's candidates; the DataFrame functions hand
these out to tasks.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that tell what is asked, not about what.
INTENT = {"活動", "利用", "役割", "特徴", "影響", "理由", "背景", "経緯", "方法", "詳", "具体的"}
#: Fixed values of windows and contexts, in characters (and blocks).
WINDOW, LEAD, TAIL, MOST_HITS, MOST_WINDOWS = 1000, 240, 120, 64, 3
LEFT, RIGHT, NEIGHBOURS, CORE, LONGEST, SNAP = 650, 1100, 12, 1200, 2400, 160
_SENTENCE_END = re.compile(r"[。！？\n]")

Group = tuple[str, float, list[str]]  # term, weight, aliases


# --- choice --------------------------------------------------------------------------------------------------------
def greedy(
    rows: Sequence[dict], limit: int, per_doc: float, per_section: float = 0.0, english_every: int = 0, english_share: float = 1.0,
    clash: Callable[[dict, dict], bool] | None = None, score: str = "relevance",
) -> list[int]:
    """Indices of the chosen rows, best first: the worth of a row is its score (not negative) / (1 + per_doc * chosen of its
    document + per_section * chosen of its section). Every english_every-th place goes to the best English row if it is
    worth english_share of the best one. A row that clashes with a chosen one is passed over. Ties go to the earlier row.

    Rows of one document, section and language share their penalty, so they wait in one queue in order of score; the heads
    of the queues are in a heap. Penalties only grow: a head whose worth has fallen is put back when it comes up."""
    queues: dict[tuple, deque[int]] = {}
    for i in sorted(range(len(rows)), key=lambda i: -rows[i][score]):
        queues.setdefault((rows[i]["doc_id"], rows[i].get("section"), rows[i].get("lane") == "en"), deque()).append(i)
    docs, sections, chosen = Counter(), Counter(), []

    def entry(key: tuple) -> tuple[float, int, tuple]:
        head = queues[key][0]
        return -rows[head][score] / (1 + per_doc * docs[key[0]] + per_section * sections[key[:2]]), head, key

    def front(heap: list) -> tuple[float, int, tuple] | None:
        while heap:
            key = heap[0][2]
            if not queues[key]:
                heapq.heappop(heap)
            elif (now := entry(key))[:2] != heap[0][:2]:
                heapq.heapreplace(heap, now)
            else:
                return now
        return None

    everything, english = [entry(k) for k in queues], [entry(k) for k in queues if k[2]]
    heapq.heapify(everything), heapq.heapify(english)
    while len(chosen) < limit and (best := front(everything)):
        if english_every and len(chosen) % english_every == english_every - 1 and (other := front(english)) and other[0] <= english_share * best[0]:
            best = other
        i, key = queues[best[2]].popleft(), best[2]
        if clash is None or not any(clash(rows[i], rows[j]) for j in chosen):
            chosen.append(i)
            docs[key[0]] += 1
            sections[key[:2]] += 1
    return chosen


def _segments(x: dict) -> list[tuple[int, int, int]]:
    if x.get("segments") is None:
        return [(x["block"], x["start"], x["end"])]
    return [(s["pos"], s["start"], s["end"]) if isinstance(s, dict) else tuple(s) for s in x["segments"]]


def shared_part(a: dict, b: dict) -> float:
    """Characters that two passages of a document have in common, over the length of the shorter. A passage has segments
    (block, start, end), or is one of its own."""
    if a["doc_id"] != b["doc_id"]:
        return 0.0
    one, two = (_segments(x) for x in (a, b))
    of = {s[0]: s for s in two}  # a passage has one segment of a block
    both = sum(max(0, min(s[2], of[s[0]][2]) - max(s[1], of[s[0]][1])) for s in one if s[0] in of)
    size = lambda x, segments: len(x["quote"]) if x.get("quote") is not None else sum(s[2] - s[1] for s in segments)
    return both / max(1, min(size(a, one), size(b, two)))


def half_shared(a: dict, b: dict) -> bool:
    return shared_part(a, b) >= 0.5


# --- windows -------------------------------------------------------------------------------------------------------
def worth(low: str, groups: list[Group], start: int = 0, end: int | None = None) -> tuple[float, int, list[str]]:
    """Relevance, groups covered (words of intent aside) and words found in a lower-cased text between two places."""
    total, covered, found = 0.0, 0, []
    for term, weight, aliases in groups:
        here = [w for w in (term, *aliases) if low.find(w.lower(), start, len(low) if end is None else end) >= 0]
        if here:
            total += weight if here[0] == term else 0.85 * weight
            covered += term not in INTENT
            found += here
    return total, covered, list(dict.fromkeys(found))


def _places(low: str, word: str) -> Iterator[int]:
    at = low.find(word)
    while at >= 0:
        yield at
        at = low.find(word, at + len(word))


def evidence_windows(text: str, groups: list[Group], size: int = WINDOW, most: int = MOST_WINDOWS) -> list[tuple[int, int]]:
    """(start, end) of up to `most` windows around hits, the most relevant first (ties: the earlier), none of which shares half
    of the shorter one with another."""
    low = text.lower()
    telling = [g for g in groups if g[0] not in INTENT] or groups
    words = [w.lower() for term, _, aliases in telling for w in (term, *aliases) if w]
    starts = {max(0, p - back) for w in words for p in islice(_places(low, w), MOST_HITS) for back in (LEAD, size - TAIL)}
    spans = sorted((-worth(low, groups, s, s + size)[0], s, min(len(text), s + size)) for s in starts)
    kept: list[tuple[int, int]] = []
    for _, a, b in spans:
        if len(kept) < most and all(2 * (min(b, d) - max(a, c)) < min(b - a, d - c) for c, d in kept):
            kept.append((a, b))
    return kept


# --- context -------------------------------------------------------------------------------------------------------
def in_context(before: list[str], hit: str, after: list[str], start: int, end: int) -> tuple[str, list[tuple[int, int, int]], bool, bool]:
    """A passage of hit with what stands around it: blocks before until LEFT characters and after until RIGHT are reached, cut
    to LONGEST, moved to sentence ends. before and after: the neighbours that may be used, in order, one more than
    NEIGHBOURS at most. -> quote, segments (block relative to the hit, start, end), whether text goes on before and after."""

    def take(sizes: list[int], have: int, want: int) -> int:
        return min(bisect_left(list(accumulate(sizes, initial=have)), want), len(sizes), NEIGHBOURS)

    left = take([len(t) + 1 for t in reversed(before)], start, LEFT)
    right = take([len(t) + 1 for t in after], len(hit) - end, RIGHT)
    parts = [*before[len(before) - left :], hit, *after[:right]]
    at = list(accumulate((len(p) + 1 for p in parts), initial=0))
    text, first, last = "\n".join(parts), at[left] + start, at[left] + end
    low = max(0, first - LEFT)
    high = min(len(text), max(last, first + CORE) + RIGHT, low + LONGEST)
    if low and (m := _SENTENCE_END.search(text, low, min(first, low + SNAP))):
        low = m.end()
    if high < len(text):
        high = max((m.end() for m in _SENTENCE_END.finditer(text, max(last, high - SNAP), high)), default=high)
    spans = [(k - left, max(low - a, 0), min(high - a, len(p))) for k, (a, p) in enumerate(zip(at, parts, strict=False))]
    return text[low:high], [s for s in spans if s[2] > s[1]], low > 0 or left < len(before), high < len(text) or right < len(after)


def expanded(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (doc_id, pos, start, end, ...) over blocks (doc_id, pos, text and, where they have them, page and section) with
    quote, segments (pos, start, end), prefix, suffix: the neighbours of the same page and section, of a document's blocks in
    order. Only documents with hits are read. Blocks and hits of a document are sorted by place and streamed: a text goes
    through the shuffle once and not with each of its neighbours, and a task holds the blocks near the open hits."""
    page, section = (F.col(c).cast("string") if c in blocks.columns else F.lit("") for c in ("page", "section"))
    near = blocks.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    hit = F.struct(*[F.col(f"`{c}`") for c in hits.columns])
    kind = hits.select(hit.alias("h")).schema[0].dataType
    near = near.select("doc_id", "pos", F.lit(0).alias("_hit"), page.alias("_page"), section.alias("_section"), F.col("text").alias("_text"), F.lit(None).cast(kind).alias("_row"))
    asked = hits.select("doc_id", "pos", F.lit(1).alias("_hit"), *(F.lit(None).cast("string").alias(c) for c in ("_page", "_section", "_text")), hit.alias("_row"))
    rows = near.unionByName(asked).repartition("doc_id").sortWithinPartitions("doc_id", "pos", "_hit")
    reach = NEIGHBOURS + 1

    def passage(window: list[tuple], at: int, start: int, end: int) -> tuple:
        """Of the block window[at] = (pos, page, section, text) or the first of its place."""
        i = next(k for k, r in enumerate(window) if r[0] == window[at][0])
        own, a, b = window[i][1:3], i, i
        while a > 0 and window[a - 1][1:3] == own:
            a -= 1
        while b + 1 < len(window) and window[b + 1][1:3] == own:
            b += 1
        quote, segments, prefix, suffix = in_context([r[3] for r in window[a:i]], window[i][3], [r[3] for r in window[i + 1 : b + 1]], start, end)
        return quote, [{"pos": window[i + k][0], "start": s, "end": e} for k, s, e in segments], prefix, suffix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple] = []  # the document's blocks, without those that no open hit reaches
        first, doc = 0, object()  # number of seen[0] in its document
        waiting: deque[tuple[int, dict]] = deque()  # number of a block, and a hit on it
        out: list[tuple[dict, tuple]] = []

        def finish(all_of_them: bool) -> None:
            while waiting and (all_of_them or waiting[0][0] + reach < first + len(seen)):
                n, row = waiting.popleft()
                low = max(0, n - reach - first)
                out.append((row, passage(seen[low : n + reach + 1 - first], n - first - low, row["start"], row["end"])))

        def taken(kinds: pa.StructType) -> pa.RecordBatch:
            made = list(zip(*(m for _, m in out), strict=True)) if out else [()] * 4
            own = [pa.array([r[f.name] for r, _ in out], f.type) for f in kinds]
            segments = pa.list_(pa.struct([("pos", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            more = [pa.array(list(c), t) for c, t in zip(made, (pa.string(), segments, pa.bool_(), pa.bool_()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([*own, *more], names=[*(f.name for f in kinds), "quote", "segments", "prefix", "suffix"])

        kinds = None
        for batch in batches:
            kinds = batch.schema.field("_row").type
            for d, pos, is_hit, *block, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d is None:
                    continue
                if d != doc:
                    finish(True)
                    seen, first, doc = [], 0, d
                if not is_hit:
                    seen.append((pos, *block))
                    finish(False)
                    if len(seen) > 8 * reach:
                        last = seen[-1][0]  # blocks of the last place may still be hit
                        same = sum(1 for _ in takewhile(lambda r: r[0] == last, reversed(seen)))  # noqa: B023
                        gone = min([n for n, _ in waiting], default=first + len(seen)) - first
                        if (gone := min(gone, len(seen) - same) - reach) > 4 * reach:
                            del seen[:gone]
                            first += gone
                else:  # all blocks of its place are there
                    n = len(seen) - 1
                    while n >= 0 and seen[n][0] == pos:
                        n -= 1
                    waiting.extend((first + k, row) for k in range(n + 1, len(seen)))
                if len(out) >= 2000:
                    yield taken(kinds)
        finish(True)
        if kinds is not None:
            yield taken(kinds)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields)
    return rows.mapInArrow(run, f"{fields}, quote string, segments array<struct<pos:int,start:int,end:int>>, prefix boolean, suffix boolean")
