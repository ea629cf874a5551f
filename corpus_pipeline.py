"""The pipeline from raw documents to shards of a training mix; its stages are in airloft/llm/pipeline.py."""

from airloft.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
