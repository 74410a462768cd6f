"""Operators that need a page's lines together in order: reading orders, duplicate reads, greedy groupings. Each is a plain
function of one page's columns (lists) and is run over all pages of a partition in turn; a page is bounded by what fits on
paper. With a pandas frame of one page they give a frame."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

Page = dict[str, list]
#: Rows of the page in their new order, and the columns that are new or changed.
Made = tuple[list[int], Page]

_ARROW = {"long": pa.int64(), "int": pa.int32()}


def per_page(rows: DataFrame, fn: Callable[[Page], Made], schema: str, needs: tuple[str, ...], keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """fn over each page of rows, of which only keys, pos and `needs` are read. Pages are not handed over one by one: a
    partition is sorted by page and streamed, and only the columns that are needed go through the shuffle."""
    order = [c for c in ("pass_no", "pos") if c == "pos" or c in needs]
    names = list(dict.fromkeys([*keys, "pos", *needs]))
    fields = [f.split() for f in schema.split(", ")]
    target = pa.schema([(n, _ARROW[kind]) for n, kind in fields])
    exact = {*keys, *order, "text"}  # a missing number counts as nan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Page = {n: [] for n in names}

        def done(upto: int, starts: list[int]) -> pa.RecordBatch:
            out: Page = {n: [] for n, _ in fields}
            for a, b in zip(starts, [*starts[1:], upto], strict=True):
                page = {n: v[a:b] for n, v in held.items()}
                made, added = fn(page)
                for n, to in out.items():
                    to.extend(added[n] if n in added else map(page[n].__getitem__, made))
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

        for batch in batches:
            seen = len(held[keys[0]])
            for n in names:
                v = batch.column(n).to_pylist()
                held[n].extend([math.nan if e is None else e for e in v] if n not in exact and batch.column(n).null_count else v)
            of = list(zip(*(held[k] for k in keys), strict=True))
            starts = [i for i in range(max(1, seen), len(of)) if of[i] != of[i - 1]]
            if starts:  # the last page may go on in the next batch
                yield done(starts[-1], [0, *starts[:-1]])
                held = {n: v[starts[-1] :] for n, v in held.items()}
        if held[keys[0]]:
            yield done(len(held[keys[0]]), [0])

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _page_function(fn: Callable[..., Made]) -> Callable:
    """fn, also over a pandas frame of one page."""

    @functools.wraps(fn)
    def run(page, *options, **named):
        if not isinstance(page, pd.DataFrame):
            return fn(page, *options, **named)
        rows, added = fn({c: page[c].tolist() for c in page.columns}, *options, **named)
        return page.iloc[rows].reset_index(drop=True).assign(**added)

    return run


def one_after_other(first: Callable[[Page], Made], second: Callable[[Page], Made]) -> Callable[[Page], Made]:
    def run(page: Page) -> Made:
        rows, added = first(page)
        again, changed = second({n: [v[i] for i in rows] for n, v in page.items()} | added)
        return [rows[i] for i in again], {n: [v[i] for i in again] for n, v in added.items()} | changed

    return run


def _last(values: list) -> list:
    """As sort keys: nan after all others."""
    return [math.inf if v != v else v for v in values]


def _sorted(*keys: list) -> list[int]:
    return sorted(range(len(keys[0])), key=list(zip(*map(_last, keys), strict=True)).__getitem__)


def _median(values: list) -> float:
    v = sorted(x for x in values if x == x)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else math.nan


def _numbered(rows: list[int], **columns: list) -> Made:
    return rows, {**columns, "reading_order": list(range(1, len(rows) + 1))}


def clusters(values: list[float], tolerance: float) -> list[int]:
    """Cluster number of each value (given sorted): joins while within the tolerance of the open cluster's mean."""
    out, total, n, c = [], 0.0, 0, -1
    for v in values:
        if n and abs(v - total / n) <= tolerance:
            total, n = total + v, n + 1
        else:
            c, total, n = c + 1, v, 1
        out.append(c)
    return out


@_page_function
def vertical_order(page: Page, tolerance: float = 60) -> Made:
    """Columns from right to left, top to bottom in each."""
    left = [-(x + w / 2) for x, w in zip(page["x"], page["w"], strict=True)]
    first = _sorted(left, page["y"], page["pos"])
    col = clusters([left[i] for i in first], tolerance)
    again = _sorted(col, [page["y"][i] for i in first], [page["pos"][i] for i in first])
    return _numbered([first[k] for k in again], col=[col[k] for k in again])


@_page_function
def horizontal_order(page: Page) -> Made:
    """Rows from top to bottom with a tolerance of 20 or 0.7 of the median height, left to right in each."""
    cy = [y + h / 2 for y, h in zip(page["y"], page["h"], strict=True)]
    first = _sorted(cy, page["x"], page["pos"])
    row = clusters([cy[i] for i in first], max(20.0, 0.7 * _median(page["h"])))
    again = _sorted(row, [page["x"][i] for i in first], [page["pos"][i] for i in first])
    return _numbered([first[k] for k in again], row=[row[k] for k in again])


@_page_function
def margin_order(page: Page, vertical: bool = False) -> Made:
    """Comparator sort: lines whose places differ by less than 0.3 of the median size count as one row (or column)."""
    size = 0.3 * _median(page["w" if vertical else "h"])
    along, across = (page["y"], [-(x + w) for x, w in zip(page["x"], page["w"], strict=True)]) if vertical else (page["x"], page["y"])

    def compare(a: int, b: int) -> int:
        d = across[a] - across[b]
        return (1 if d > 0 else -1) if abs(d) > size else (along[a] > along[b]) - (along[a] < along[b])

    return _numbered(sorted(range(len(across)), key=functools.cmp_to_key(compare)))


@_page_function
def xy_cut(page: Page, least_gap: int = 8) -> Made:
    """Cuts, again and again, at the widest empty band of the projections, rows before columns on equal widths."""
    x0, y0 = page["x"], page["y"]
    x1, y1 = [a + b for a, b in zip(x0, page["w"], strict=True)], [a + b for a, b in zip(y0, page["h"], strict=True)]
    by_x, by_y, place = _sorted(x0), _sorted(y0), list(zip(_last(y0), _last(x0), range(len(x0)), strict=True))

    def gap(ids: list[int], lo: list, hi: list) -> tuple[float, float]:
        best, at, end = 0, 0, None
        for i in ids:
            if end is None:
                end = hi[i]
                continue
            if lo[i] - end > best:
                best, at = lo[i] - end, end
            if hi[i] > end:
                end = hi[i]
        return best, at

    order: list[int] = []
    parts = [(by_x, by_y)]  # the lines of a part by both coordinates; the next part is the last
    while parts:
        xs, ys = parts.pop()
        if len(xs) > 1:
            (gy, ay), (gx, ax) = gap(ys, y0, y1), gap(xs, x0, x1)
            if max(gx, gy) >= least_gap:
                end, at = (y1, ay) if gy >= gx else (x1, ax)
                parts.append(([i for i in xs if not end[i] <= at], [i for i in ys if not end[i] <= at]))
                parts.append(([i for i in xs if end[i] <= at], [i for i in ys if end[i] <= at]))
                continue
        order.extend(sorted(xs, key=place.__getitem__))
    return _numbered(order)


@_page_function
def smoothed_order(page: Page) -> Made:
    """Of the orders that move every line by one place at most (two on pages of under 20 lines), the one of least total
    distance between successive lines, by dynamic programming over which near lines are taken. Needs reading_order.

    A state is (lines taken, as bits from the first line in reach on; last line) with its cost and its path, whose steps are
    the digits of a number, so that equal costs go to the first path."""
    rows = _sorted(page["reading_order"])
    n, reach = len(rows), 2 if len(rows) < 20 else 1
    x, y = (np.array([page[a][i] + page[b][i] / 2 for i in rows]) for a, b in (("x", "w"), ("y", "h")))
    far = [[], *(np.hypot(x[k:] - x[:-k], y[k:] - y[:-k]).tolist() for k in range(1, min(n, 2 * reach + 2)))]
    wide = 2 * reach + 1
    states: dict[tuple[int, int], tuple[float, int]] = {(0, -1): (0.0, 0)}
    for place in range(n):
        after: dict[tuple[int, int], tuple[float, int]] = {}
        start = place - reach
        steps = range(max(0, -start), min(wide, n - start))
        for (taken, last), (cost, path) in states.items():
            for b in steps if start < 0 or taken & 1 else (0,):
                if taken >> b & 1:
                    continue
                i = start + b
                to = (cost if last < 0 else cost + (far[i - last][last] if i > last else far[last - i][i]), path * wide + b)
                key = ((taken | 1 << b) >> 1, i)
                if key not in after or to < after[key]:
                    after[key] = to
        states = after
    path, best = min(states.values())[1], [0] * n
    for place in reversed(range(n)):
        path, b = divmod(path, wide)
        best[place] = rows[place - reach + b]
    return _numbered(best)


def _area(page: Page, i: int, j: int) -> float:
    x, y, w, h = page["x"], page["y"], page["w"], page["h"]
    return max(0, min(x[i] + w[i], x[j] + w[j]) - max(x[i], x[j])) * max(0, min(y[i] + h[i], y[j] + h[j]) - max(y[i], y[j]))


def _meeting(page: Page) -> list[list[int]]:
    """For each line the lines whose boxes share an area with its own: a sweep from top to bottom."""
    y, h = page["y"], page["h"]
    near: list[list[int]] = [[] for _ in y]
    open_: list[int] = []
    for i in _sorted(y):
        open_ = [j for j in open_ if y[j] + h[j] > y[i]]
        for j in open_:
            if _area(page, i, j) > 0:
                near[i].append(j)
                near[j].append(i)
        open_.append(i)
    return near


@_page_function
def adjacent_deduplicated(page: Page, share: float = 0.8) -> Made:
    """In order, a line that overlaps the last kept one by over `share` of the smaller area replaces it if its confidence is
    higher, else goes."""
    size, sure = [w * h for w, h in zip(page["w"], page["h"], strict=True)], page["confidence"]
    kept: list[int] = []
    for r in _sorted(page["y"], page["x"], page["pos"]):
        if kept and _area(page, kept[-1], r) > share * max(1, min(size[kept[-1]], size[r])):
            if sure[r] > sure[kept[-1]]:
                kept[-1] = r
        else:
            kept.append(r)
    return kept, {}


@_page_function
def suppressed(page: Page, limit: float = 0.5) -> Made:
    """Non-maximum suppression by the larger of IoU and 0.85 of the overlap of the smaller box, best confidence first."""
    size, near, kept = [w * h for w, h in zip(page["w"], page["h"], strict=True)], _meeting(page), set()

    def score(k: int, r: int) -> float:
        both, a, b = _area(page, k, r), size[k], size[r]
        return max(both / max(1, a + b - both), 0.85 * both / max(1, min(a, b)))

    for r in (order := _sorted([-c for c in page["confidence"]], page["pos"])):
        if all(score(k, r) <= limit for k in near[r] if k in kept):
            kept.add(r)
    return sorted((r for r in order if r in kept), key=page["pos"].__getitem__), {}


def same_read(a: str, b: str) -> bool:
    """The shorter text stands in the longer, with at most two glyphs or 8 per cent of it different."""
    if a == b:
        return True
    a, b = sorted(("".join(a.split()), "".join(b.split())), key=len)
    if not a:
        return True
    allowed = max(2, int(0.08 * len(a)))
    for at in range(len(b) - len(a) + 1):
        wrong = 0
        for x, y in zip(a, b[at:], strict=False):
            wrong += x != y
            if wrong > allowed:
                break
        if wrong <= allowed:
            return True
    return False


def _alike(a: str, b: str, least: float) -> bool:
    """The matching-block ratio is at least `least`; its cheap upper bounds are asked first."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


@_page_function
def fused_passes(page: Page) -> Made:
    """Lines of several recognition passes (column pass_no): a line that overlaps a kept one by half of the smaller box and
    reads the same goes, the longer text stays; others are added; weak short copies (confidence under 0.3) go too."""
    size, text, sure = [w * h for w, h in zip(page["w"], page["h"], strict=True)], page["text"], page["confidence"]
    near, kept, places, at = _meeting(page), [], [], {}  # at: where a kept line stands
    for r in _sorted(page["pass_no"], page["pos"]):
        for i in sorted(at[k] for k in near[r] if k in at):
            k = kept[i]
            if _area(page, k, r) > 0.5 * max(1, min(size[k], size[r])):
                weak = sure[r] < 0.3 and len(text[r]) <= len(text[k])
                if weak or same_read(text[k], text[r]) or _alike(text[k], text[r], 0.8):
                    if len(text[r]) > len(text[k]) and not weak:
                        del at[k]
                        kept[i], at[r] = r, i
                    break
        else:
            at[r] = len(kept)
            kept.append(r)
            places.append(page["pos"][r])
    return kept, {"pos": places}


@_page_function
def band_groups(page: Page, factor: float = 2.5) -> Made:
    """Groups along y: a new one starts where no line covers a band of over `factor` median heights."""
    rows = _sorted(page["y"], page["x"], page["pos"])
    gap, end, g, out = factor * _median(page["h"]), None, 0, []
    for i in rows:
        y, h = page["y"][i], page["h"][i]
        if end is not None and y - end > gap:
            g += 1
        end = y + h if end is None else max(end, y + h)
        out.append(g)
    return rows, {"band": out}


@_page_function
def seed_groups(page: Page, grow: float = 0.1) -> Made:
    """Small-print groups: each free line in order is a seed and takes the free lines that its box, grown by a tenth,
    touches; what they touch does not count."""
    rows = _sorted(page["y"], page["x"], page["pos"])
    x, y, w, h = ([page[c][i] for i in rows] for c in "xywh")
    group, g = [-1] * len(rows), 0
    for i in range(len(rows)):
        if group[i] >= 0:
            continue
        group[i] = g
        x0, y0 = x[i] - grow * w[i], y[i] - grow * h[i]
        x1, y1 = x0 + w[i] * (1 + 2 * grow), y0 + h[i] * (1 + 2 * grow)
        for j in range(i + 1, len(rows)):
            if y[j] >= y1:  # so are all others
                break
            if group[j] < 0 and max(0, min(x1, x[j] + w[j]) - max(x0, x[j])) * max(0, min(y1, y[j] + h[j]) - max(y0, y[j])) > 0:
                group[j] = g
        g += 1
    return rows, {"seed_group": group}


def split_quotes(text: str, size: int = 400, least: int = 80, tail: int = 8) -> list[str]:
    """Pieces of at most `size` characters that end at the last sentence end after `least` characters, else at the size;
    a tail of under `tail` visible characters joins the piece before."""
    out, at = [], 0
    while at < len(text):
        part = text[at : at + size]
        if at + size < len(text):
            ends = [i for i, c in enumerate(part) if c in "。！？!?.\n" and i + 1 >= least]
            part = part[: ends[-1] + 1] if ends else part
        out.append(part)
        at += len(part)
    if len(out) > 1 and len("".join(out[-1].split())) < tail:
        out[-2:] = [out[-2] + out[-1]]
    return [p for p in out if p.strip()]


def realigned(text: str, lines: list[str]) -> list[str]:
    """A corrected text dealt back to the lines it came from, along the matching blocks of both."""
    joined = "".join(lines)
    owner = [i for i, s in enumerate(lines) for _ in s]
    out = [""] * len(lines)
    for op, a0, a1, b0, b1 in SequenceMatcher(None, joined, text, autojunk=False).get_opcodes():
        if op == "equal":
            for k in range(a1 - a0):
                out[owner[a0 + k]] += text[b0 + k]
        elif b1 > b0 and lines:
            at = owner[a0] if a0 < len(owner) else len(lines) - 1
            if op == "insert" and a0:
                at = owner[a0 - 1]
            out[at] += text[b0:b1]
    return out


def in_polygon(x: float, y: float, polygon: list[tuple[float, float]]) -> bool:
    """Even-odd rule; points on an edge count as inside."""
    inside, n = False, len(polygon)
    for i in range(n):
        (x1, y1), (x2, y2) = polygon[i], polygon[(i + 1) % n]
        if min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) and (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside
