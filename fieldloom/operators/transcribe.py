"""From recorded chunks to validated text."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text as T

#: A backend is made once per worker, by a factory, and turns an audio file's path into text.
Backend = Callable[[str], str]
DEMO = "Sample transcript: no speech service answered."
_backends: dict[str, Backend] = {}


def backend_of(factory: Callable[[], Backend]) -> Backend:
    """The factory's backend, made once in a worker process. Callers import this where they run: a function that is
    shipped to a worker takes its own copy of the names of its module along."""
    made = f"{factory.__module__}.{factory.__qualname__}"
    if made not in _backends:
        _backends[made] = factory()
    return _backends[made]


def demo_rows(spark: SparkSession, recording_id: str = "demo", text: str = DEMO) -> DataFrame:
    """The demo text as the one row of a transcription that was asked for."""
    return spark.range(1).select(F.lit(recording_id).alias("recording_id"), F.lit(text).alias("transcription"), F.lit(None).cast("string").alias("error"))


def stub_backend() -> Backend:
    """A stand-in for a speech model, none of which is here: the file read as UTF-8."""

    def read(path: str) -> str:
        with open(path, "rb") as f:
            return f.read().decode("utf-8", "replace")

    return read


def assemble(chunks: DataFrame) -> DataFrame:
    """recording_id and content: the chunks that are not empty, joined in their order."""
    kept = chunks.where(F.octet_length("bytes") > 0)
    return kept.groupBy("recording_id").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY seq)").alias("content"))


def transcribe(audio: DataFrame, factory: Callable[[], Backend] = stub_backend, key: str = "recording_id", name: str | None = None) -> DataFrame:
    """key, transcription and error. Each row's bytes go to a temporary file of the right suffix that is always
    removed; a failure is that row's error and ends nothing else. The suffix comes from the column `name`."""
    suffix = T.file_suffix(name) if name else F.lit(".wav")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from fieldloom.operators.transcribe import backend_of

        backend = backend_of(factory)
        for pdf in parts:
            texts, errors = [], []
            for content, end in zip(pdf["content"], pdf["suffix"], strict=True):
                path = None
                try:
                    with tempfile.NamedTemporaryFile(suffix=end, delete=False) as f:
                        path = f.name
                        f.write(content or b"")
                    texts.append(backend(path))
                    errors.append(None)
                except Exception as e:  # any failure of a backend is the row's outcome
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                finally:
                    if path and os.path.exists(path):
                        os.unlink(path)
            yield pd.DataFrame({key: pdf[key], "transcription": texts, "error": errors})

    rows = audio.select(F.col(key).cast("string").alias(key), "content", suffix.alias("suffix"))
    out = rows.mapInPandas(run, f"{key} string, transcription string, error string")
    return out.withColumn("transcription", T.py_strip("transcription"))


def gate(status: Column, transcription: Column) -> Column:
    """The text of a response with a status from 200 to 299 and some text, else null."""
    return F.when(status.between(200, 299), F.when(T.truthy(transcription), transcription))


def with_fallback(text: Column, use: bool = False, demo: str = DEMO) -> tuple[Column, Column]:
    """The text, empty for none, and whether it is the demo text; that takes an explicit choice and is always told."""
    missing = ~T.truthy(text)
    return F.when(missing, F.lit(demo if use else "")).otherwise(text), missing & F.lit(use)


def fill_enabled(has_target: Column, text: Column) -> Column:
    return F.coalesce(has_target, F.lit(False)) & T.truthy(T.js_trim(text))


def insertable(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with some text that a person accepted."""
    return rows.where(T.truthy(T.js_trim(text)) & F.coalesce(F.col("accepted"), F.lit(False)))


def written(value: Column, back: Column) -> Column:
    return F.when(value.eqNullSafe(back), F.lit("inserted")).otherwise(F.lit("failed"))
