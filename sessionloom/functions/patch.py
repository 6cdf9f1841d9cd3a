"""Patches: an update with one hunk is an edit, an added file a write, anything else stays as it is."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, END = "*** Begin Patch", "*** End Patch"


def read_patch(text: str) -> tuple[str, dict] | None:
    """(tool, input) of a patch on one file, or None."""
    lines = text.strip("\n").split("\n")
    if len(lines) < 3 or lines[0].strip() != BEGIN or lines[-1].strip() != END:
        return None
    head, body = lines[1], lines[2:-1]
    if any(x.startswith("*** ") and not x.startswith("*** End of File") for x in body):
        return None
    if head.startswith("*** Add File: "):
        if any(not x.startswith("+") for x in body):
            return None
        return "Write", {"content": "".join(x[1:] + "\n" for x in body), "file_path": head[14:].strip()}
    if not head.startswith("*** Update File: "):
        return None
    hunks = [i for i, x in enumerate(body) if x.startswith("@@")]
    if len(hunks) > 1 or (hunks and hunks[0] != 0):
        return None
    rows = [x for x in body[1 if hunks else 0 :] if not x.startswith("*** End of File")]
    if any(x[:1] not in ("+", "-", " ", "") for x in rows):
        return None
    old = [x[1:] for x in rows if x[:1] in ("-", " ", "")]
    new = [x[1:] for x in rows if x[:1] in ("+", " ", "")]
    if old == new:
        return None
    return "Edit", {"file_path": head[17:].strip(), "new_string": "\n".join(new), "old_string": "\n".join(old)}


@F.pandas_udf(T.StructType([T.StructField("tool", T.StringType()), T.StructField("input", T.StringType())]))
def patch_tool(text: pd.Series) -> pd.DataFrame:
    """read_patch() of a column: tool and canonical input, nulls where a patch stays as it is."""
    got = [read_patch(t) if t is not None else None for t in text]
    return pd.DataFrame({"tool": [g[0] if g else None for g in got], "input": [json.dumps(g[1], sort_keys=True, separators=(",", ":"), ensure_ascii=False) if g else None for g in got]})
