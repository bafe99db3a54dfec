"""kbspark: a Spark-native knowledge-base engine.

Ingest heterogeneous landed content into one ``Content`` schema, embed it,
maintain it by keyed upsert and retention, retrieve by cosine similarity for
whole tables of queries at once, and assemble retrieval-augmented prompts.

Every operator takes and returns DataFrames; nothing passes whole through
the driver except explicitly size-checked broadcasts.
"""

from kbspark.session import get_session, scratch_dir

__version__ = "0.1.0"

_EXPORTS = {
    # retrieval
    "similar_documents": "kbspark.operators.retrieve", "top_k_batch": "kbspark.operators.retrieve",
    "vector_topk": "kbspark.operators.retrieve", "build_ivf": "kbspark.operators.ann",
    "ann_topk": "kbspark.operators.ann", "assign_ivf": "kbspark.operators.ann", "StoredIndex": "kbspark.operators.ann",
    "CodedIndex": "kbspark.operators.coded", "cosine_similarity": "kbspark.functions.vectors",
    # models and answers
    "HashingEmbedder": "kbspark.operators.embed", "BatchModelEmbedder": "kbspark.operators.embed",
    "embed_documents": "kbspark.operators.embed", "ExtractiveGenerator": "kbspark.operators.generate",
    "BatchModelGenerator": "kbspark.operators.generate", "generate_answers": "kbspark.operators.generate",
    "rag": "kbspark.operators.rag", "build_prompt": "kbspark.functions.text",
    "register_sql": "kbspark.functions.sql",
    # store
    "upsert_documents": "kbspark.operators.store", "vector_upsert": "kbspark.operators.store",
    "retention_survivors": "kbspark.operators.store", "retention_counts": "kbspark.operators.store",
    "get_documents": "kbspark.operators.store", "get_document": "kbspark.operators.store",
    "count_documents": "kbspark.operators.store", "kb_constraints": "kbspark.operators.store",
    "SnapshotStore": "kbspark.sources.snapshot", "scan_kb": "kbspark.sources.snapshot",
    "BucketStore": "kbspark.sources.buckets",
    # ingest and registry
    "parse_api": "kbspark.sources.api", "parse_pages": "kbspark.sources.web",
    "stitch_pages": "kbspark.sources.pages", "parse_videos": "kbspark.sources.video",
    "parse_feeds": "kbspark.sources.feed", "register_sources": "kbspark.operators.registry",
    "active_sources": "kbspark.operators.registry", "touch_sources": "kbspark.operators.registry",
    "dispatch": "kbspark.operators.registry", "ingest_sources": "kbspark.plans.ingest",
    "ingest_updates": "kbspark.plans.ingest", "ingest_report": "kbspark.plans.ingest",
    # streaming
    "stream_updates": "kbspark.streaming.stream", "stream_sources": "kbspark.streaming.stream",
    "assemble_pages": "kbspark.streaming.pages", "read_accounting": "kbspark.streaming.stream",
}

__all__ = ["get_session", "scratch_dir", *_EXPORTS]


def __getattr__(name):
    """Lazy re-exports: ``kbspark.rag``, ``kbspark.upsert_documents``, ..."""
    mod = _EXPORTS.get(name)
    if mod is None:
        raise AttributeError(name)
    import importlib
    return getattr(importlib.import_module(mod), name)
