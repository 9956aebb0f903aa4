"""Explicit schemas of the stored tables; lists are native arrays, times are UTC."""

from pyspark.sql import types as T

_S, _A, _TS, _I = T.StringType(), T.ArrayType(T.StringType()), T.TimestampType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PAPERS = _struct(doc_id=_S, title=_S, created_at=_TS, is_favorite=T.BooleanType(), tags=_A)
CHUNKS = _struct(chunk_id=_S, doc_id=_S, page=_I, text=_S)
GAPS = _struct(gap_id=_S, title=_S, value_level=_S, description=_S, evidence_papers=_A, created_at=_TS)
EXPERIMENTS = _struct(experiment_id=_S, gap_id=_S, objective=_S, datasets=_A, metrics=_A, baselines=_A, steps=_A, risks=_A, support_papers=_A)
NOTES = _struct(note_id=_S, title=_S, content=_S, tags=_A, related_doc_id=_S, related_gap_id=_S, created_at=_TS)
VECTORS = _struct(chunk_id=_S, doc_id=_S, page=_I, text=_S, tags=_A, module_source=_S, content_hash=_S, profile_key=_S, embedding=T.ArrayType(T.DoubleType()), seq=T.LongType())
ENTRIES = _struct(chunk_id=_S, profile_key=_S, collection_name=_S, content_hash=_S, status=_S, error=_S, updated_at=_TS)
INDEX_STATE = _struct(profile_key=_S, active_collection=_S, state=_S, updated_at=_TS)
MIGRATIONS = _struct(migration_id=_S, profile_key=_S, source_collection=_S, target_collection=_S, status=_S, started_at=_TS, completed_at=_TS, processed_count=_I, skipped_count=_I, failed_count=_I, error=_S)
BATCHES = _struct(migration_id=_S, batch=_I, status=_S, processed_count=_I, skipped_count=_I, failed_count=_I, finished_at=_TS)

TABLES = {"papers": PAPERS, "chunks": CHUNKS, "gaps": GAPS, "experiments": EXPERIMENTS, "notes": NOTES, "vectors": VECTORS, "entries": ENTRIES, "index_state": INDEX_STATE, "migrations": MIGRATIONS, "batches": BATCHES}
KEYS = {"papers": ["doc_id"], "chunks": ["chunk_id"], "gaps": ["gap_id"], "experiments": ["experiment_id"], "notes": ["note_id"], "vectors": ["chunk_id", "profile_key"], "entries": ["chunk_id", "profile_key"], "index_state": ["profile_key"], "migrations": ["migration_id"], "batches": ["migration_id", "batch"]}
