"""Unicode forms, which Spark has no function for, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DASHES = dict.fromkeys(map(ord, "‐‑‒–—―−－ー"), "-")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(unicodedata.normalize("NFKC", x).translate(_DASHES).split()).casefold())


def folded_key(text: Column) -> Column:
    """NFKC, dashes alike, no spaces, case folded."""
    return _folded(text)


def compatibility_ideographs() -> dict[str, str]:
    """Compatibility ideographs (U+F900 to U+FAFF) with the single characters that NFKC gives for them."""
    forms = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xF900, 0xFB00))
    return {c: form for c, form in forms if form != c and len(form) == 1}


def new_forms(text: Column, old_new: dict[str, str]) -> Column:
    """Old forms of ideographs as new ones. `old_new` (single characters) is the caller's table, such as that of a national
    list; compatibility ideographs are folded first, by NFKC, and then mapped like the rest. Null stays null."""
    table = {c: old_new.get(form, form) for c, form in compatibility_ideographs().items()} | old_new
    return F.translate(text, "".join(table), "".join(table.values()))


class _Styler(HTMLParser):
    def __init__(self, styles: dict[str, str]) -> None:
        super().__init__(convert_charrefs=False)
        self.styles, self.out = styles, []

    def handle_starttag(self, tag, attrs):
        raw = self.get_starttag_text()
        if (style := self.styles.get(tag)) is not None:
            rest = "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in attrs if k != "style")
            raw = f'<{tag}{rest} style="{style}">'
        self.out.append(raw)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        self.out.append(data)

    def handle_entityref(self, name):
        self.out.append(f"&{name};")

    def handle_charref(self, name):
        self.out.append(f"&#{name};")

    def handle_comment(self, data):
        self.out.append(f"<!--{data}-->")


def restyled(page: str, styles: dict[str, str]) -> str:
    """Start tags of the named elements get the style; all else stays as it is."""
    p = _Styler(styles)
    p.feed(page)
    p.close()
    return "".join(p.out)
