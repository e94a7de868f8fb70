"""Folding of neighbouring results of one source, with a cap per source: greedy in rank order, one group a query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

#: Markdown blocks one apart fold; video segments less than two seconds apart, or overlapping enough.
BLOCK_GAP, VIDEO_GAP_MS, OVERLAP = 1, 2000, 0.30


def _adjacent(head: dict, row: dict) -> bool:
    if (head["source_file_id"], head["index_role"], head["parent"]) != (row["source_file_id"], row["index_role"], row["parent"]):
        return False
    if head["asset_type"] != row["asset_type"]:
        return False
    if row["asset_type"] == "markdown_block":
        return abs(head["block"] - row["block"]) <= BLOCK_GAP
    if row["asset_type"] != "video_segment":
        return False
    gap = max(head["start_ms"], row["start_ms"]) - min(head["end_ms"], row["end_ms"])
    shortest = min(head["end_ms"] - head["start_ms"], row["end_ms"] - row["start_ms"])
    return 0 <= gap < VIDEO_GAP_MS or (gap < 0 and shortest > 0 and -gap / shortest > OVERLAP)


def fold_rows(rows: list[dict], top_k: int, cap: int = 3) -> list[dict]:
    """Results in rank order with the ids folded into each.

    A row joins the first result that it is next to, which then spans both; of blocks a result remembers only the
    highest. Only a row that joins none counts against its source's cap. Once there are top_k results, all ends: later rows
    are not folded either.
    """
    out: list[dict] = []
    per_source: dict[str, int] = {}
    for row in rows:
        if len(out) >= top_k:
            break
        target = next((h for h in out if _adjacent(h, row)), None)
        if target is not None:
            target["folded"].append(row["asset_id"])
            if row["asset_type"] == "markdown_block":
                target["block"] = max(target["block"], row["block"])
            else:
                target["start_ms"] = min(target["start_ms"], row["start_ms"])
                target["end_ms"] = max(target["end_ms"], row["end_ms"])
            continue
        if per_source.get(row["source_file_id"], 0) >= cap:
            continue
        per_source[row["source_file_id"]] = per_source.get(row["source_file_id"], 0) + 1
        out.append(row | {"folded": [row["asset_id"]]})
    return out


def fold(results: DataFrame, top_k: int, cap: int = 3) -> DataFrame:
    """(query_no, position, asset_id, folded array) of results(query_no, pos, asset_id, source_file_id, asset_type,
    index_role, parent, block, start_ms, end_ms); a query has at most the candidate cap's rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = fold_rows(pdf.sort_values("pos").to_dict("records"), top_k, cap)
        return pd.DataFrame(
            {
                "query_no": pdf["query_no"].iloc[0],
                "position": pd.Series(range(1, len(rows) + 1), dtype="int32"),
                "asset_id": [r["asset_id"] for r in rows],
                "folded": [r["folded"] for r in rows],
            }
        )

    return results.groupBy("query_no").applyInPandas(one, "query_no int, position int, asset_id string, folded array<string>")
