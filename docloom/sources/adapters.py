"""What needs image libraries or models: protocols, a registry with an order of preference, and Arrow plumbing.

None of these libraries comes with the package. A backend is a function from image bytes to lines or
payloads; it is made once in a worker process and used for all its images.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.extract import LINES
from docloom.shipping import ship


class OcrBackend(Protocol):
    def __call__(self, image: bytes) -> list[dict]:
        """Lines as dicts of text, x, y, w, h, confidence."""


class QrBackend(Protocol):
    def __call__(self, image: bytes) -> list[str]: ...


class ImageStep(Protocol):
    def __call__(self, image: bytes) -> bytes: ...


def no_lines(image: bytes) -> list[dict]:
    return []


@dataclass(frozen=True)
class Backend:
    name: str
    needs: tuple[str, ...]  # modules that must be there
    make: Callable[[], OcrBackend]


#: In order of preference; the last one needs nothing.
OCR_BACKENDS: list[Backend] = [Backend("stub", (), lambda: no_lines)]
QR_BACKENDS: list[Backend] = []


def register(backend: Backend, kind: list[Backend] = OCR_BACKENDS, first: bool = True) -> None:
    kind.insert(0 if first else len(kind), backend)


def choose(kind: list[Backend] = OCR_BACKENDS, forced: str | None = None) -> Backend:
    """The forced backend, or the first one whose modules can be imported."""
    for backend in kind:
        if forced is not None and backend.name != forced:
            continue
        try:
            for module in backend.needs:
                importlib.import_module(module)
        except ImportError:
            if forced is not None:
                raise
            continue
        return backend
    raise LookupError(f"no backend {forced or ''}".strip())


def recognise(images: DataFrame, backend: Backend | None = None) -> DataFrame:
    """images(doc_id, content) with lines and _error; one image that fails costs its own row only. Blank lines are dropped."""
    ship(images.sparkSession)
    chosen = backend or choose()
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("w", pa.float64()), ("h", pa.float64()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = chosen.make()
        for batch in batches:
            lines, errors = [], []
            for content in batch.column(1).to_pylist():
                try:
                    found = [o for o in read(content) if o["text"].strip()]
                    lines.append([{"confidence": 1.0, **o, "line_no": i} for i, o in enumerate(found)])
                    errors.append(None)
                except Exception as bad:
                    lines.append([])
                    errors.append(str(bad))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, kind), pa.array(errors, pa.string())], ["doc_id", "lines", "_error"])

    return images.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, f"doc_id string, lines {LINES}, _error string")


def decode_qr(images: DataFrame, backend: Backend) -> DataFrame:
    """images(doc_id, content) -> (doc_id, payloads, _error)."""
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = backend.make()
        for batch in batches:
            found, errors = [], []
            for content in batch.column(1).to_pylist():
                try:
                    found.append([*dict.fromkeys(read(content))])
                    errors.append(None)
                except Exception as bad:
                    found.append([])
                    errors.append(str(bad))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(errors, pa.string())], ["doc_id", "payloads", "_error"])

    return images.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, "doc_id string, payloads array<string>, _error string")


def map_images(images: DataFrame, step: Callable[[], ImageStep]) -> DataFrame:
    """images(doc_id, content) with content replaced by what a step (rectify, orient, annotate) makes of it; a failure keeps the image and says why in _error."""
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = step()
        for batch in batches:
            out, errors = [], []
            for content in batch.column(1).to_pylist():
                try:
                    out.append(do(content))
                    errors.append(None)
                except Exception as bad:
                    out.append(content)
                    errors.append(str(bad))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["doc_id", "content", "_error"])

    return images.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, "doc_id string, content binary, _error string")


@dataclass(frozen=True)
class RectifyConfig:
    """The constants of rectification."""

    work_size: int = 1000
    min_area: float = 0.10
    skip_fill: float = 0.90
    skip_skew: float = 3.0
    margin: float = 0.012
    pad: float = 0.02
    out_long: int = 2000
    aspect: tuple[float, float] | None = None
    landscape: bool = False


#: Overrides by preset; users may add theirs.
PRESETS: dict[str, dict] = {"default": {}, "id_card": {"aspect": (1.2, 2.3), "landscape": True, "skip_fill": 0.88, "skip_skew": 4.0}}


def preset(name: str, **overrides) -> RectifyConfig:
    return replace(RectifyConfig(), **{**PRESETS[name], **overrides})
