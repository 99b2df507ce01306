"""Asking a scorer about items, one Arrow batch at a time."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The scorer and this module travel to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANSWER = ("path string, key string, context string, text string, tags array<string>, reasons map<string, string>, "
          "category string, product string, description string, specs string, "
          "input_tokens bigint, output_tokens bigint, retries bigint, ms double, error string, status int")
_FIELDS = ("text", "tags", "reasons", "category", "product", "description", "specs",
           "input_tokens", "output_tokens", "retries")
# What a request hands on, and what is noted about a call; with the fields these are the columns of ANSWER.
_SENT = ("path", "key", "context")
_NOTED = ("ms", "error", "status")
# The Arrow types of the columns that are not texts.
_KINDS = {"tags": pa.list_(pa.string()), "reasons": pa.map_(pa.string(), pa.string()), "input_tokens": pa.int64(),
          "output_tokens": pa.int64(), "retries": pa.int64(), "ms": pa.float64(), "status": pa.int32()}


def _status(exc: Exception) -> int | None:
    """The HTTP status that clients put on their errors, under one of two names."""
    found = getattr(exc, "status_code", None)
    found = getattr(exc, "status", None) if found is None else found
    return found if isinstance(found, int) else None


def _as_fields(answer: Any) -> dict[str, Any]:
    if isinstance(answer, str):
        return {"text": answer}
    if isinstance(answer, (list, tuple)):
        return {"tags": [str(t) for t in answer]}
    if type(answer) is dict:
        return answer
    get = answer.get if isinstance(answer, dict) else lambda name: getattr(answer, name, None)
    return {name: get(name) for name in _FIELDS}


def _column(name: str, values: list) -> pa.Array:
    """One field of many answers, whatever kinds of list, dict or number they came as."""
    kind = _KINDS.get(name, pa.string())
    if name == "tags":
        values = [None if v is None else list(v) for v in values]
    elif name == "reasons":
        values = [None if v is None else list(v.items()) for v in values]
    elif pa.types.is_integer(kind) and not {type(v) for v in values} <= {int, type(None)}:
        import pandas as pd

        return pa.Array.from_pandas(pd.Series(values).astype("Int32" if kind == pa.int32() else "Int64"), type=kind)
    return pa.array(values, kind, from_pandas=True)


def ask(requests: DataFrame, scorer: Callable[[], Any], examples: tuple[Sequence[dict], int] | None = None) -> DataFrame:
    """U-1, U-3: one answer per request, or the error it met.

    `requests` has path, key, content_b64, media_type, context and feedback.
    `examples` are a pool and how many of it to show with an item, its own
    left out; they travel once per task, not per request. `scorer()` is called once per task and gives an object with
    `predict` (image, media type, context, examples, feedback) or the plainer
    `predict_tags` (without feedback). Requests carry whole images; Spark bounds
    an Arrow batch in bytes (`spark.sql.execution.arrow.maxBytesPerBatch`). An answer may be a raw text, a tag list,
    or an object or dict with any of the answer's fields.
    """
    drawn = set() if examples is None else {e["path"] for e in examples[0]}

    def shown(path: str) -> list[dict] | None:
        if examples is None:
            return None
        pool, limit = examples
        return [e for e in pool if e["path"] != path][:limit] if path in drawn else [*pool[:limit]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = scorer()
        full = getattr(client, "predict", None)
        for batch in batches:
            named = dict(zip(batch.schema.names, batch.columns))
            told = [named[c].to_numpy(zero_copy_only=False).tolist() for c in ("path", "context", "media_type", "feedback")]
            answers, noted = [], {name: [] for name in _NOTED}
            # One image at a time, as a batch of them is large.
            images = (image.as_py() for image in named["content_b64"])
            for image, path, context, kind, feedback in zip(images, *told):
                fields, error, status = {}, None, None
                started = time.perf_counter()
                given = {"context": context, "examples": shown(path)}
                try:
                    if full is None:
                        answer = client.predict_tags(image, kind, **given)
                    else:
                        answer = full(image, kind, **given, feedback=feedback)
                    fields = _as_fields(answer)
                except Exception as exc:  # one bad item must not end the run
                    error = f"{type(exc).__name__}: {exc}"
                    status = _status(exc)
                noted["ms"].append((time.perf_counter() - started) * 1000)
                noted["error"].append(error)
                noted["status"].append(status)
                answers.append(fields)
            got = {**{name: [fields.get(name) for fields in answers] for name in _FIELDS}, **noted}
            columns = [*map(named.get, _SENT), *(_column(name, values) for name, values in got.items())]
            yield pa.RecordBatch.from_arrays(columns, [*_SENT, *got])

    return requests.select(
        "path", "key", "content_b64", "media_type", "context", "feedback"
    ).mapInArrow(run, ANSWER)
