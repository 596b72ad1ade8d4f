"""Results as text, on the driver, within a budget of bytes."""

from __future__ import annotations

import json
from collections.abc import Sequence

from sievework.operators.chunking import truncate_to_budget

FIELDS = ("file_path", "line_start", "line_end", "content", "language", "symbol_type", "symbol_name", "part_index", "score")


def as_dict(row, compact: bool = False) -> dict:
    d = {f: row[f] if f in row else None for f in FIELDS}
    if compact:
        d = {k: v for k, v in d.items() if v is not None and k not in ("score", "language")}
    return d


def to_json(rows: Sequence, budget: int | None = None, compact: bool = False) -> str:
    """Rows in rank order; lower ones are dropped whole until the text fits, a single one has its content shortened."""
    items = [as_dict(r, compact) for r in rows]
    text = json.dumps(items, ensure_ascii=False)
    while budget is not None and len(text.encode()) > budget and len(items) > 1:
        items.pop()
        text = json.dumps(items, ensure_ascii=False)
    if budget is None or len(text.encode()) <= budget:
        return text
    lo, hi, content = 0, len((items[0].get("content") or "").encode()), items[0].get("content") or ""
    best = "[]"
    while lo <= hi:
        mid = (lo + hi) // 2
        items[0]["content"] = truncate_to_budget(content, mid)
        text = json.dumps(items, ensure_ascii=False)
        if len(text.encode()) <= budget:
            best, lo = text, mid + 1
        else:
            hi = mid - 1
    return best


def to_markdown(rows: Sequence, budget: int | None = None) -> str:
    """One block per result; the budget of content bytes is spent in rank order."""
    out, left = [], budget
    for r in rows:
        d = as_dict(r)
        content = d["content"] or ""
        if left is not None:
            if left <= 0:
                break
            content = truncate_to_budget(content, left)
            left -= len(content.encode())
        name = f" `{d['symbol_name']}`" if d["symbol_name"] else ""
        out.append(f"### {d['file_path']}:{d['line_start']}-{d['line_end']}{name}\n```{d['language'] or ''}\n{content}\n```")
    return "\n\n".join(out)
