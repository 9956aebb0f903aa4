"""Registries of embedding and chat providers; offline ones are deterministic."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions import vectors as V


@dataclass(frozen=True)
class Embedding:
    """A provider: its profile, and a transport (texts -> vectors) or none for the hash vector.

    A call gets up to ``batch`` texts.  One that raises, or does not give one vector of the dimension a text, is tried
    ``retries`` times more; then its texts get hash vectors, flagged as fallbacks with what went wrong."""

    name: str
    model: str
    dimension: int
    setting: str | None = None
    transport: Callable[[list[str]], list[list[float]]] | None = None
    schema_version: int = 2
    batch: int = 64
    retries: int = 1

    @property
    def key(self) -> str:
        return f"v{self.schema_version}:{self.name}:{self.model}:{self.dimension}"

    @property
    def collection(self) -> str:
        words = re.sub("[^a-z0-9]+", "_", f"{self.name}_{self.model}".lower()).strip("_")
        return f"paper_chunks_v{self.schema_version}_{words}_{self.dimension}"

    @property
    def is_fallback(self) -> bool:
        """Nothing can be embedded: there is no transport, and the provider is not the offline one."""
        return self.transport is None and self.name != "mock"

    def embed(self, text: Column) -> tuple[Column, bool]:
        """(vector column, is_fallback) by built-in hashing; where a transport can fail, use ``embedded``."""
        if self.transport is None:
            return V.hash_vector(text, self.dimension), self.is_fallback
        return self._asked()(text)["vector"], False

    def embedded(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with embedding, is_fallback and embedding_error of each.  Every text is sent once (and once more a
        retry of its call) each time the result is evaluated: write it before it is read twice."""
        own = V.hash_vector(F.coalesce(text, F.lit("")), self.dimension)
        if self.transport is None:
            told = F.lit(f"{self.name} has no transport; hash vectors stand in.") if self.is_fallback else F.lit(None).cast("string")
            return rows.withColumns({"embedding": own, "is_fallback": F.lit(self.is_fallback), "embedding_error": told})
        asked = rows.withColumn("_asked", self._asked()(F.col(text)))
        found = {"embedding": F.coalesce("_asked.vector", own), "is_fallback": F.col("_asked.vector").isNull(), "embedding_error": F.col("_asked.error")}
        return asked.withColumns(found).drop("_asked")

    def _asked(self):
        call, batch, tries, dimension = self.transport, self.batch, self.retries + 1, self.dimension

        def answer(texts: list[str]) -> tuple[list, str | None]:
            told = None
            for _ in range(tries):
                try:
                    vectors = [[float(x) for x in v] for v in call(texts)]
                    if len(vectors) != len(texts) or any(len(v) != dimension for v in vectors):
                        raise ValueError(f"{len(texts)} texts need as many vectors of length {dimension}")
                    return vectors, None
                except Exception as error:  # whatever a provider raises: its texts fall back, flagged
                    told = f"Embedding failed: {error}"[:500]
            return [None] * len(texts), told

        @F.pandas_udf("vector array<double>, error string")
        def asked(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for part in parts:
                texts = part.fillna("").tolist()
                vectors, errors = [], []
                for lo in range(0, len(texts), batch):
                    some, error = answer(texts[lo : lo + batch])
                    vectors += some
                    errors += [error] * len(some)
                yield pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

        return asked


# The known providers in listing order.
EMBEDDINGS = (Embedding("mock", "mock-embedding", 16), Embedding("openai", "text-embedding-3-small", 1536, "OPENAI_API_KEY"), Embedding("local-bge-m3", "bge-m3", 1024), Embedding("xfyun-spark", "query", 2560, "XFYUN_API_KEY"))
CHATS = (("mock", "mock-chat", None), ("deepseek", "deepseek-chat", "DEEPSEEK_API_KEY"), ("openai", "gpt-4o-mini", "OPENAI_API_KEY"))


def embedding(name: str, document: bool = False) -> Embedding:
    """By name, unknown names as mock; one provider has a model of its own for documents."""
    found = next((e for e in EMBEDDINGS if e.name == name), EMBEDDINGS[0])
    return replace(found, model="para") if document and found.name == "xfyun-spark" else found


def model_options(spark: SparkSession, settings: dict[str, str] | None = None) -> DataFrame:
    """kind, provider, model, available and warning of every option."""
    have = settings or {}
    rows = [("embedding", e.name, e.model, e.setting) for e in EMBEDDINGS] + [("chat", *c) for c in CHATS]
    out = [(kind, name, model, s is None or bool(have.get(s)), None if s is None or have.get(s) else f"{s} is not configured.") for kind, name, model, s in rows]
    return spark.createDataFrame(out, "kind string, provider string, model string, available boolean, warning string")


#: Deterministic answers of the mock chat by the marker its prompt begins with.
MOCK_ANSWERS = {
    "READING_QA": "根据已检索片段，论文给出了相关方法与结果 [1]。",
    "GAP_JSON": '{"gaps": [{"title": "评估覆盖不足", "value_level": "high", "description": "缺少跨领域评估。", "evidence_papers": []}]}',
    "EXPERIMENT_JSON": '{"experiments": [{"objective": "验证检索质量", "datasets": ["公开基准"], "metrics": ["NDCG"], "baselines": ["BM25"], "steps": ["准备数据", "运行基线"], "risks": ["标签噪声"]}]}',
}


def mock_answer(prompt: Column) -> Column:
    out = None
    for marker, answer in MOCK_ANSWERS.items():
        hit = F.contains(prompt, F.lit(marker))
        out = F.when(hit, answer) if out is None else out.when(hit, answer)
    return out.otherwise("mock answer")


def slug(e: Embedding) -> Column:
    return X.collection_slug(F.lit(e.schema_version), F.lit(e.name), F.lit(e.model), F.lit(e.dimension))
