"""Text of bounded results: call trees, impact lists and search answers. Only capped results reach the driver."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import hop_label
from graphloom.operators.graph import clamp_depth
from graphloom.plans.schema import EDGE_LABELS


def down_rows(capped: DataFrame, root: str, depth: int | None = None) -> list[tuple[int, str, str, str, bool]]:
    """(depth, src, dst, edge_type, seen before) in the order of a depth-first walk over down_capped()'s edges.

    An edge is expanded once in the whole walk; where it comes again it is marked and not followed.
    """
    steps: dict[str, list[tuple[int, str, str, int]]] = defaultdict(list)
    for r in capped.where(F.col("root") == root).collect():
        steps[r["src"]].append((r["rank"], r["dst"], r["edge_type"], r["hidden"]))
    out: list[tuple[int, str, str, str, bool]] = []
    visited: set[tuple[str, str]] = set()

    def walk(node: str, level: int, left: int) -> None:
        for _, dst, kind, _ in sorted(set(steps.get(node, ()))):
            again = (node, dst) in visited
            out.append((level, node, dst, kind, again))
            if not again:
                visited.add((node, dst))
                if left > 1:
                    walk(dst, level + 1, left - 1)

    walk(root, 1, clamp_depth(depth))
    return out


def render_down(capped: DataFrame, root: str, depth: int | None = None) -> str:
    """The downstream tree as indented text."""
    hidden = {r["src"]: r["hidden"] for r in capped.where(F.col("root") == root).select("src", "hidden").distinct().collect()}
    lines, rows = [root], down_rows(capped, root, depth)
    for k, (level, src, dst, kind, again) in enumerate(rows):
        tag = EDGE_LABELS.get(kind, "")
        lines.append("  " * level + "→ " + dst + (f" {tag}" if tag else "") + (" ↩" if again else ""))
        rest = [r for r in rows[k + 1 :] if r[0] <= level]
        if hidden.get(src) and (not rest or rest[0][0] < level):
            lines.append("  " * level + f"… {hidden[src]} more")
    return "\n".join(lines)


def up_rows(refs: dict[tuple[str, str | None], list[tuple[str, str, list[str]]]], symbol: str, file: str | None, depth: int | None = None) -> list[tuple[int, str, str, bool]]:
    """(depth, caller, file, seen before) of the upstream tree: refs gives, for (symbol, from file), shown files as (file, first caller, callers)."""
    out: list[tuple[int, str, str, bool]] = []
    visited: set[tuple[str, str]] = set()

    def walk(sym: str, origin: str | None, level: int, left: int) -> None:
        for home, first, callers in refs.get((sym, origin), []):
            key = (first, home)
            again = key in visited
            out.extend((level, c, home, again) for c in callers)
            if again:
                continue
            visited.add(key)
            if left > 1:
                for c in callers:
                    walk(c, home, level + 1, left - 1)

    walk(symbol, file, 1, clamp_depth(depth))
    return out


def render_impact(summary: DataFrame) -> str:
    """impact_summary() as text, a paragraph for each hop."""
    lines = []
    for r in summary.withColumn("label", hop_label(F.col("hop"))).orderBy("hop", "edge_type").collect():
        more = r["n"] - len(r["names"])
        lines.append(f"{r['label']} {r['edge_type']} ({r['n']}): " + ", ".join(r["names"]) + (f" … {more} more" if more else ""))
    return "\n".join(lines)


def render_search(found: DataFrame) -> str:
    """search() as text, a line for each row, tiers in their order."""
    tiers = {t: k for k, t in enumerate(("hint", "exact", "prefix", "fuzzy", "path", "text"))}
    rows = sorted(found.collect(), key=lambda r: (tiers[r["tier"]], r["rank"] or 0, r["path"] or ""))
    return "\n".join(f"[{r['tier']}] " + " ".join(str(r[c]) for c in ("name", "path", "n", "example") if r[c] is not None) for r in rows) or "no results"
