"""Search and chunking as SQL table functions over TABLE arguments.

```sql
SELECT c.article_id, c.content_chunk, h.similarity
FROM first_rows(TABLE(SELECT * FROM similar_rows(TABLE(SELECT chunk_id, content_chunk_vector FROM chunks), 'a question', NULL))) h
JOIN chunks c ON c.chunk_id = h.id
```

Functions that see a whole table work on Arrow batches; those have fixed result columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, SkipRestOfInputTableException

from passagework.functions import chunking
from passagework.functions.embedding import Provider
from passagework.functions.vectors import LocalTopK, matrix

HITS = StructType().add("id", LongType()).add("similarity", DoubleType()).add("top_k", IntegerType())
CHUNKS = "id bigint, chunk_no int, content_chunk string, n_tokens bigint"


def similar_rows(provider: Provider, default_k: int) -> type:
    """`similar_rows(TABLE(SELECT id, vector …), query, topK)`: every task's best rows.

    A NULL topK stands for `default_k`; NULL vectors take no part. The query is embedded
    once in each task. Only topK rows leave a task, so `first_rows` over them is cheap
    whatever the table's size.
    """

    class SimilarRows:
        def __init__(self):
            self.best = None

        def eval(self, table: pa.RecordBatch, query: pa.Array, topK: pa.Array) -> Iterator[pa.Table]:
            if not table.num_rows:
                return
            if self.best is None:
                text, k = query[0].as_py(), topK[0].as_py()
                if text is None or (k is not None and k < 0):
                    raise ValueError("query must not be NULL and topK not negative")
                self.top_k = default_k if k is None else k
                (vector,) = provider.embed([text])
                self.best = LocalTopK(np.array([vector], np.float64), np.array([self.top_k]))
            there = table.filter(table.column(1).is_valid())
            ids = there.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            self.best.add(ids, matrix(there.column(1), provider.dim))
            yield from ()

        def terminate(self) -> Iterator[pa.Table]:
            if self.best is not None:
                top_k = np.full(len(self.best.ids), self.top_k, np.int32)
                yield pa.table({"id": self.best.ids, "similarity": self.best.scores, "top_k": top_k})

    return SimilarRows


class FirstRows:
    """`first_rows(TABLE(… similar_rows …))`: the topK best of all tasks' rows, ties to the smaller id.

    Its plan asks for the few rows in one partition, sorted; the rest of them is skipped.
    """

    def __init__(self):
        self.given = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or rows.dataType.names != HITS.names:
            raise ValueError("first_rows takes a TABLE of similar_rows")
        order = [OrderingColumn("similarity", ascending=False), OrderingColumn("id")]
        return AnalyzeResult(schema=StructType(HITS.fields[:2]), withSinglePartition=True, orderBy=order)

    def eval(self, rows: Row):
        if self.given >= rows["top_k"]:
            raise SkipRestOfInputTableException()
        self.given += 1
        yield rows["id"], rows["similarity"]


class ChunkText:
    """`chunk_text(TABLE(SELECT id, text …), budget)`: a row for every chunk of every text."""

    def eval(self, table: pa.RecordBatch, budget: pa.Array) -> Iterator[pa.Table]:
        if not table.num_rows:
            return
        words = budget[0].as_py()
        if words is None or words < 1:
            raise ValueError("the budget must be positive")
        rows, chunks = [], []
        for row, text in enumerate(table.column(1).to_pylist()):
            if text is not None:
                own = list(chunking.chunks(text, words))
                rows += [row] * len(own)
                chunks += own
        numbers, bodies, tokens = zip(*chunks) if chunks else ((), (), ())
        yield pa.table(
            {
                "id": table.column(0).cast(pa.int64()).take(pa.array(rows, pa.int64())),
                "chunk_no": pa.array(numbers, pa.int32()),
                "content_chunk": pa.array(bodies, pa.string()),
                "n_tokens": pa.array(tokens, pa.int64()),
            }
        )


def register_chunk_text(spark: SparkSession, name: str = "chunk_text") -> None:
    """Make `ChunkText` callable in SQL."""
    spark.udtf.register(name, F.arrow_udtf(ChunkText, returnType=CHUNKS))


def register_search(
    spark: SparkSession, provider: Provider, default_k: int, name: str = "similar_rows"
) -> None:
    """Make `similar_rows`, under `name`, and `first_rows` callable in SQL."""
    spark.udtf.register(name, F.arrow_udtf(similar_rows(provider, default_k), returnType=HITS))
    spark.udtf.register("first_rows", F.udtf(FirstRows))
