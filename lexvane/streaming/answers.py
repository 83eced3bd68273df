"""A rolling answer cache on streams: each namespace keeps its answers in state for as long as they live. Not part of the retrieval model.

Answers and questions come in one stream of (kind, namespace, query_id, query, embedding, response): ``answer`` rows are kept,
``ask`` rows are replied to with the first live entry that is similar enough. Entries expire by the state's time to live, in
processing time; state survives restarts with the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexvane.operators.cache import SIMILARITY, TTL_SECONDS

INPUT = "kind string, namespace string, query_id string, query string, embedding array<double>, response string, seq long"
OUTPUT = "namespace string, query_id string, hit boolean, cached_query string, similarity double, response string"


class AnswerState(StatefulProcessor):
    """The entries of one namespace: a map from their number to query, embedding and response, each with its own time to live.

    A batch's rows are taken by ``seq``; an entry is found by questions after it, of the same batch too.
    """

    def __init__(self, ttl_seconds: int = TTL_SECONDS, threshold: float = SIMILARITY) -> None:
        self.ttl_ms, self.threshold = 1000 * ttl_seconds, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "seq long", "query string, embedding array<double>, response string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held = sorted((k[0], *v) for k, v in self.entries.iterator())
        out = []
        for r in every.itertuples(index=False):
            v = np.asarray(r.embedding, np.float64)
            if r.kind == "answer":
                held.append((int(r.seq), r.query, v, r.response))
                self.entries.updateValue((int(r.seq),), (r.query, [float(x) for x in v], r.response))
                continue
            near = ((float(np.asarray(e, np.float64) @ v), q, a) for _, q, e, a in held if len(e) == len(v))
            score, query, response = next((x for x in near if x[0] >= self.threshold), (None, None, None))
            out.append((key[0], r.query_id, score is not None, query, score, response))
        yield pd.DataFrame(out, columns=["namespace", "query_id", "hit", "cached_query", "similarity", "response"]).astype({"hit": bool, "similarity": float})

    def close(self) -> None:
        pass


def rolling_answers(rows: DataFrame, ttl_seconds: int = TTL_SECONDS, threshold: float = SIMILARITY) -> DataFrame:
    """Replies to the ``ask`` rows of a stream, from its ``answer`` rows. The session's state store has to be RocksDB."""
    grouped = rows.groupBy("namespace")
    return grouped.transformWithStateInPandas(AnswerState(ttl_seconds, threshold), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")
