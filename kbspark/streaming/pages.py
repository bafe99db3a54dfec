"""R2 with S5: documents whose pages arrive in several micro-batches.

``assemble_pages`` keeps the pages of each open document as keyed state and passes a document on as one landed row
when its pages are complete (``page_count`` says how many there are) or when none has come for ``timeout``; what comes
later opens it anew. Rows of other kinds (no ``page_no``) pass unchanged.

State: one row per open document, in the state store of the stream's checkpoint, dealt out by a hash of (source_id,
url); a completed document leaves it. A group's rows are its document's pages, and the output row is the whole
document by definition. A page that comes twice counts once (the later one stands); NULL page texts count as pages
and add nothing; a NULL ``page_count`` never completes a document, so the timer does; rows with a NULL source or url
are documents of their own key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_LANDED = "source_id string, url string, body string, page_no long, fetched_at timestamp"


def _assembler(timeout_ms: int):
    def assemble(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages, total, latest = {}, None, None
        if state.exists:
            held, total, latest = state.get
            pages, latest = json.loads(held), pd.Timestamp(latest, unit="us") if latest is not None else None
        if not state.hasTimedOut:
            for f in frames:
                for no, text, count, at in zip(f["page_no"], f["body"], f["page_count"], f["fetched_us"]):
                    pages[str(int(no))] = None if pd.isna(text) else text
                    total = total if pd.isna(count) else int(count)
                    at = None if pd.isna(at) else pd.Timestamp(int(at), unit="us")
                    latest = at if latest is None else latest if at is None else max(latest, at)
            if total is None or len(pages) < total:
                state.update((json.dumps(pages), total, None if latest is None else latest.value // 1000))
                state.setTimeoutDuration(timeout_ms)
                return
        if state.exists:
            state.remove()
        text = "".join(pages[no] or "" for no in sorted(pages, key=int))
        yield pd.DataFrame({"source_id": [key[0]], "url": [key[1]], "body": [text], "page_no": pd.array([1], "Int64"),
                            "fetched_at": pd.Series([latest], dtype="datetime64[us]")})
    return assemble


def assemble_pages(landed: DataFrame, timeout: int = 60 * 60 * 1000) -> DataFrame:
    """Landed rows (source_id, url, body, page_no, page_count, fetched_at) of a stream -> landed rows with one
    row per document. ``timeout`` in milliseconds of processing time; in a drain (``available_now``) timers
    fire together with the next data."""
    cols = ["source_id", "url", "body", "page_no", "fetched_at"]
    paged = (landed.filter(F.col("page_no").isNotNull())
             .select("source_id", "url", "body", F.col("page_no").cast("long").alias("page_no"), F.col("page_count").cast("long").alias("page_count"),
                     F.unix_micros("fetched_at").alias("fetched_us")))
    whole = paged.groupBy("source_id", "url").applyInPandasWithState(
        _assembler(int(timeout)), _LANDED, "pages string, total long, latest long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return landed.filter(F.col("page_no").isNull()).select(*cols).unionByName(whole.select(*cols))
