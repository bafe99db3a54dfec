"""SQL building blocks for the DuckDB oracle of the registered queries.

These are the engine-independent twins of the default embedder and of the
ranking key, written in plain SQL so an independent engine checks the Spark plans.
"""

from __future__ import annotations

from kbspark.operators.embed import TOKEN_SPLIT

NL2 = "chr(10) || chr(10)"


def embed_sparse(src: str, id_expr: str, text_expr: str, dim: int) -> str:
    """Rows (id, b, v): non-zero buckets of the hashed bag-of-words embedding, v as FLOAT."""
    return f"""(
  SELECT id, b, (c / sqrt(sum(c * c) OVER (PARTITION BY id)))::FLOAT AS v
  FROM (
    SELECT id, b, count(*)::DOUBLE AS c
    FROM (
      SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS b
      FROM (
        SELECT {id_expr} AS id,
               unnest(list_filter(regexp_split_to_array(lower({text_expr}), '{TOKEN_SPLIT}'),
                                  lambda x: x <> '')) AS tok
        FROM {src}
      )
    ) GROUP BY id, b
  )
)"""


def sparse_cosine_keys(qv: str, dv: str) -> str:
    """(query_id, doc_id, sim_key) for every pair sharing a bucket, from two sparse tables."""
    return f"""(
  SELECT p.query_id, p.doc_id,
         CAST(floor(p.dp / (qn.n * dn.n) * 1e9 + 0.5) AS BIGINT) AS sim_key
  FROM (SELECT x.id AS query_id, y.id AS doc_id, sum(x.v::DOUBLE * y.v::DOUBLE) AS dp
        FROM {qv} x JOIN {dv} y USING (b) GROUP BY 1, 2) p
  JOIN (SELECT id, sqrt(sum(v::DOUBLE * v::DOUBLE)) AS n FROM {qv} GROUP BY id) qn ON qn.id = p.query_id
  JOIN (SELECT id, sqrt(sum(v::DOUBLE * v::DOUBLE)) AS n FROM {dv} GROUP BY id) dn ON dn.id = p.doc_id
)"""


def key_of(sim_expr: str) -> str:
    return f"CAST(floor(({sim_expr}) * 1e9 + 0.5) AS BIGINT)"


def decode_entities(x: str) -> str:
    """HTML character references that occur in the landed pages, decoded as HTML does in text:
    these legacy named references need no trailing semicolon; ``&amp`` goes last."""
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '&quot;?', '\"', 'g'), "
            f"'&middot;?', chr(183), 'g'), '&copy;?', chr(169), 'g'), '&amp;?', '&', 'g')")
