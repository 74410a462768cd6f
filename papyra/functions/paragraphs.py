"""Recognised lines to paragraphs, for Japanese and western text, and path rewriting in markup and JSON."""

from __future__ import annotations

import json
import re

_END = "。．.！？!?」』）)"
_BULLET = re.compile(r"^\s*(?:[・●○◆◇■□▪-]|\(?\d{1,2}[).．、]|[①-⑳]|第[一二三四五六七八九十\d]+[章節条])")
_LATIN = re.compile(r"[A-Za-z0-9,;:]$")


def paragraphs(lines: list[str], full: int | None = None) -> list[str]:
    """A new paragraph begins at an indented line, at a bullet, after a blank line, and after a sentence end on a line
    shorter than 0.85 of the usual length (the median of the longer half, if not given). Japanese lines join without a
    space, western ones with one, a hyphen at a line end between letters goes."""
    sizes = sorted(len(s.strip()) for s in lines if s.strip())
    usual = full or (sizes[(len(sizes) + len(sizes) // 2) // 2] if sizes else 0)
    out: list[str] = []
    fresh = True
    for raw in lines:
        s = raw.strip()
        if not s:
            fresh = True
            continue
        if fresh or not out or raw.startswith(("　", "  ")) or _BULLET.match(raw):
            out.append(s)
        elif re.search(r"[A-Za-z]-$", out[-1]) and re.match(r"[a-z]", s):
            out[-1] = out[-1][:-1] + s
        elif _LATIN.search(out[-1]) and re.match(r"[A-Za-z0-9]", s):
            out[-1] += " " + s
        else:
            out[-1] += s
        fresh = s[-1] in _END and len(s) < 0.85 * usual
    return out


def without_garbage_prefix(text: str) -> str:
    """Leading runs of symbols, and a lone letter or digit before a space, go if a text follows them."""
    rest = re.sub(r"^(?:[^\w「『（(【〔]+|[A-Za-z0-9]\s+(?=[^\sA-Za-z0-9]))+", "", text)
    return rest if rest.strip() else text


def rewritten_paths(markup: str, old: str, new: str) -> str:
    """src and href values that begin with old begin with new."""
    return re.sub(rf'(\b(?:src|href)\s*=\s*["\']){re.escape(old)}', lambda m: m[1] + new, markup)


def rewritten_json(text: str, keys: set[str], old: str, new: str) -> str:
    """The same for string values of the named keys, at any depth; text that is no JSON stays."""

    def walk(x, key=None):
        if isinstance(x, dict):
            return {k: walk(v, k) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, key) for v in x]
        return new + x[len(old) :] if isinstance(x, str) and key in keys and x.startswith(old) else x

    try:
        return json.dumps(walk(json.loads(text)), ensure_ascii=False)
    except ValueError:
        return text


def shares(weights: list[int], cuts: list[int], text: str) -> list[str]:
    """A text split at vertical rules: weights are its characters' display widths, cuts positions on their sum."""
    out, part, at, cut = [], "", 0, list(cuts)
    for c, w in zip(text, weights, strict=True):
        while cut and at + w / 2 > cut[0]:
            out.append(part)
            part = ""
            cut.pop(0)
        part += c
        at += w
    return [*out, part, *[""] * len(cut)]
