"""The SQL surface: functions for SQL text, registered per session by ``register_sql``.

Scalar functions have SQL bodies, which the optimizer inlines (no Python):

    cosine_similarity(a, b)   X1   NULL for a NULL or zero vector, an error for different dimensions
    sim_key(similarity)       X2   the integer rank key
    update_doc_id(source, t)  X3   doc_<source>_<unix seconds>
    has_text(s)               X9   not blank
    build_prompt(contexts, question)   X8

Table functions take a partitioned, ordered TABLE argument; Spark shuffles by the partition columns:

    SELECT * FROM top_rows(TABLE(scored) PARTITION BY query_id ORDER BY (sim_key DESC, doc_id), 10)    T2, T3
    SELECT * FROM stitch_pages(TABLE(pages) PARTITION BY path ORDER BY page_no)                        S5

``top_rows`` passes a partition's first k rows on with their rank and holds none; ``stitch_pages`` holds one
document's text, which is its output row. For a whole knowledge base use ``top_k_batch``, which never forms the pairs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from kbspark.functions.text import CONTEXT_SEPARATOR, PROMPT_HEAD, PROMPT_QUESTION, PROMPT_TAIL
from kbspark.functions.vectors import SIM_SCALE


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


_SCALARS = {
    "cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": """
        CASE WHEN size(a) <> size(b) AND a IS NOT NULL AND b IS NOT NULL THEN CAST(raise_error('different vector dimensions') AS DOUBLE)
             ELSE try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),
                             nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)) END""",
    "sim_key(similarity DOUBLE) RETURNS BIGINT": f"CAST(floor(similarity * {SIM_SCALE}D + 0.5D) AS BIGINT)",
    "update_doc_id(source STRING, updated_at TIMESTAMP) RETURNS STRING":
        "concat('doc_', coalesce(source, ''), '_', CAST(unix_seconds(updated_at) AS STRING))",
    "has_text(s STRING) RETURNS BOOLEAN": r"coalesce(s RLIKE '(?U)\\S', false)",
    "build_prompt(contexts ARRAY<STRING>, question STRING) RETURNS STRING":
        f"concat({_text(PROMPT_HEAD)}, array_join(coalesce(contexts, CAST(array() AS ARRAY<STRING>)), {_text(CONTEXT_SEPARATOR)}), "
        f"{_text(PROMPT_QUESTION)}, coalesce(question, ''), {_text(PROMPT_TAIL)})",
}


class TopRows:
    """The first ``k`` rows of each partition, with their ``rank``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(k.value, int) or k.value < 0:
            raise ValueError("top_rows(TABLE(..) PARTITION BY .. ORDER BY .., k)")
        return AnalyzeResult(T.StructType([*rows.dataType.fields, T.StructField("rank", T.LongType())]))

    def __init__(self):
        self.n = 0

    def eval(self, rows, k: int):
        self.n += 1
        if self.n <= k:
            yield (*rows, self.n)


class StitchPages:
    """One row per path: the texts of its pages in the order given, NULL pages skipped."""

    def __init__(self):
        self.path, self.texts = None, []

    def eval(self, page):
        self.path = page["path"]
        if page["text"] is not None:
            self.texts.append(page["text"])

    def terminate(self):
        yield self.path or "", "".join(self.texts)


def register_sql(spark: SparkSession) -> None:
    """Register the functions above in the session (temporary; again is harmless)."""
    for signature, body in _SCALARS.items():
        head, returns = signature.split(" RETURNS ")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
    spark.udtf.register("top_rows", udtf(TopRows))
    spark.udtf.register("stitch_pages", udtf(StitchPages, returnType="path string, text string"))
