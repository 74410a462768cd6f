"""Plug-in surface: providers are plain Python objects; what they return is a DataFrame or goes through Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@runtime_checkable
class EvidenceRetriever(Protocol):
    def search(self, blocks: DataFrame, question: str, limit: int) -> DataFrame: ...


@runtime_checkable
class EmbeddingProvider(Protocol):
    """windows: (start, end) character ranges of a text; embed: one unit vector a text. Objects are sent to the workers."""

    model_key: str

    def windows(self, text: str) -> list[tuple[int, int]]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@runtime_checkable
class GenerationProvider(Protocol):
    def answer(self, question: str, sources: list[dict]) -> dict: ...


@runtime_checkable
class QueryExpansionProvider(Protocol):
    def expand(self, question: str) -> dict[str, list[str]]: ...


@runtime_checkable
class Importer(Protocol):
    """A file becomes block rows (pos, kind, level, text, html, grid, ref)."""

    suffixes: tuple[str, ...]

    def rows(self, path: str, content: bytes) -> list[tuple]: ...


class LexicalRetriever:
    """The built-in retriever."""

    def search(self, blocks: DataFrame, question: str, limit: int = 32) -> DataFrame:
        from papyra.operators.hybrid import search

        return search(blocks, question, blocks.select("doc_id").distinct().count(), limit=limit)


class HashedWords:
    """An embedding without a model: signed hashed words, L2-normalised. For tests and as an example of a provider."""

    def __init__(self, size: int = 64, chars: int = 1000, overlap: int = 160) -> None:
        self.size, self.chars, self.overlap = size, chars, overlap
        self.model_key = f"hashed-words-{size}"

    def windows(self, text: str) -> list[tuple[int, int]]:
        step = self.chars - self.overlap
        return [(i, min(len(text), i + self.chars)) for i in range(0, max(1, len(text)), step) if i == 0 or i + self.overlap < len(text)]

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.size] += 1 if h & 1 << 20 else -1
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out


def embedded_chunks(documents: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """documents (doc_id, text) -> chunk_id, doc_id, model_key, start, end, vector. Chunk ids come from model, document and
    place, so a repeated run gives equal rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, a, b, t[a:b]) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) if t and t.strip() for a, b in provider.windows(t)]
            vectors = provider.embed([r[3] for r in rows]) if rows else []
            yield pd.DataFrame([(*r[:3], v) for r, v in zip(rows, vectors, strict=True)], columns=["doc_id", "start", "end", "vector"])

    out = documents.select("doc_id", "text").mapInPandas(run, "doc_id long, start int, end int, vector array<float>")
    key = F.lit(provider.model_key)
    return out.select(F.sha2(F.concat_ws("/", key, "doc_id", "start", "end"), 256).alias("chunk_id"), "doc_id", key.alias("model_key"), "start", "end", "vector")


def expanded(question: str, provider: QueryExpansionProvider | None) -> list[str]:
    """Query variants with a provider's English queries (two at most) and terms (ten at most)."""
    from papyra.operators.hybrid import query_variants

    more = provider.expand(question) if provider else {}
    return query_variants(question, more.get("terms", [])[:10], more.get("english", [])[:2])


def imported(files: DataFrame, importers: list[Importer]) -> DataFrame:
    """binaryFile rows -> block rows by the importer of their suffix; files of no suffix known give no rows."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("pos", T.IntegerType()), ("kind", T.StringType()), ("level", T.IntegerType()), ("text", T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                one = next((i for i in importers if path.lower().endswith(i.suffixes)), None)
                rows += [(path, k, *r[:3]) for k, r in enumerate(one.rows(path, bytes(content)) if one else [])]
            yield pd.DataFrame(rows, columns=["path", "pos", "kind", "level", "text"]).astype({"level": "Int32"})

    return files.select("path", "content").mapInPandas(run, schema)


class MarkdownImporter:
    """Headings by their marks, list items, paragraphs parted by blank lines."""

    suffixes = (".md", ".txt")

    def rows(self, path: str, content: bytes) -> list[tuple]:
        out: list[tuple] = []
        for part in content.decode("utf-8", "replace").replace("\r\n", "\n").split("\n\n"):
            lines = [s for s in part.split("\n") if s.strip()]
            while lines and lines[0].startswith("#"):
                marks = len(lines[0]) - len(lines[0].lstrip("#"))
                out.append(("heading", min(6, marks), lines.pop(0).lstrip("#").strip()))
            if lines and all(s.lstrip().startswith(("- ", "* ")) for s in lines):
                out += [("list", (len(s) - len(s.lstrip())) // 2, s.lstrip()[2:]) for s in lines]
            elif lines:
                out.append(("paragraph", None, " ".join(s.strip() for s in lines)))
        return out
