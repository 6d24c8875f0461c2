"""Search results, statistics and similar files as text."""

from __future__ import annotations

import json

from pyspark.sql import Row

from semdex.plans.indexer import IndexStats

FORMATS = ("plain", "context", "json", "filename")
HEAD_LINES = 3


def result_dict(r: Row) -> dict:
    return {"file_path": r["file_path"], "chunk_index": r["chunk_index"], "similarity": r["score"], "context": r["context"], "content": r["content"]}


def render(fmt: str, query: str, index_path: str, rows: list[Row], score_kind: str, warnings: list[str]) -> str:
    if fmt == "json":
        out = {"query": query, "index_path": index_path, "score_kind": score_kind}
        if warnings:
            out["warnings"] = warnings
        return json.dumps(out | {"results": [result_dict(r) for r in rows]}, ensure_ascii=False, indent=2 if rows else None)
    if not rows:
        return "No results found."
    if fmt == "plain":
        return "\n".join(f"{r['file_path']}:{r['chunk_index']}" for r in rows)
    if fmt == "filename":
        return "\n".join(dict.fromkeys(r["file_path"] for r in rows))
    lines = [header(len(rows), score_kind)]
    for r in rows:
        lines += ["", f"{r['score']:.2f} {r['file_path']}:{r['chunk_index']}" + (f"  {r['context']}" if r["context"] else "")]
        lines += [f"  │ {line}" for line in r["content"].splitlines()[:HEAD_LINES]]
    return "\n".join(lines)


def header(n: int, score_kind: str) -> str:
    return f"Found {n} results (reranked):" if score_kind == "reranker" else f"Found {n} results:"


def human_size(n: int) -> str:
    for unit, size in (("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= size:
            return f"{n / size:.1f} {unit}"
    return f"{n} bytes"


def stats_text(s: IndexStats) -> str:
    rows = [("Index:", s.index_path), ("Root:", s.root_path), ("Files:", s.file_count), ("Chunks:", s.chunk_count)]
    rows += [("Est. tokens:", f"~{s.estimated_tokens}"), ("Model:", s.model), ("Endpoint:", s.endpoint)]
    if s.last_indexed is not None:
        rows.append(("Last indexed:", s.last_indexed.strftime("%Y-%m-%d %H:%M:%S")))
    rows.append(("Size on disk:", human_size(s.size_on_disk)))
    return "Index Statistics\n\n" + "\n".join(f"  {k:<18} {v}" for k, v in rows)


def similar_text(rows: list[Row]) -> str:
    if not rows:
        return "No similar files found."
    return f"\nFound {len(rows)} similar files:\n" + "\n".join(f"  {r['score']:.2f} {r['file_path']}" for r in rows)
