"""Where documents come from and go to."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names of images.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")

FROZEN = "image string, lines array<struct<text:string,x:double,y:double,w:double,h:double,confidence:double>>"


def read_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length, content) of the image files in a folder; sort by path for the order of a listing."""
    glob = "*.{" + ",".join(s for low in IMAGE_SUFFIXES for s in (low, low.upper())) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)


def read_frozen_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, image, lines with line_no) from JSON files of one document each; doc_id is the file's name without its suffix."""
    raw = spark.read.schema(FROZEN).option("multiLine", True).json(path)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    numbered = F.transform("lines", lambda o, i: F.struct(i.alias("line_no"), o["text"].alias("text"), o["x"].alias("x"), o["y"].alias("y"), o["w"].alias("w"), o["h"].alias("h"), o["confidence"].alias("confidence")))
    return raw.select(F.url_decode(stem).alias("doc_id"), "image", numbered.alias("lines"))


def exploded(docs: DataFrame) -> DataFrame:
    """A row for each line."""
    return docs.select("doc_id", F.explode("lines").alias("o")).select("doc_id", "o.*")


def nested(lines: DataFrame) -> DataFrame:
    """(doc_id, lines) from one row a line; the array is in the order of line_no. One shuffle, by document."""
    line = F.struct("line_no", "text", "x", "y", "w", "h", "confidence")
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def non_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim("text") != "")


def freeze(docs: DataFrame, path: str) -> None:
    """Write recognised lines as they are frozen for tests: places to 1 decimal, confidences to 4."""
    one = lambda c: F.round(c, 1)
    lines = F.transform("lines", lambda o: F.struct(o["text"].alias("text"), one(o["x"]).alias("x"), one(o["y"]).alias("y"), one(o["w"]).alias("w"), one(o["h"]).alias("h"), F.round(o["confidence"], 4).alias("confidence")))
    docs.select("image", lines.alias("lines")).write.mode("errorifexists").json(path)


def write_responses(responses: DataFrame, path: str, kind: str = "parquet") -> None:
    responses.write.mode("errorifexists").format(kind).save(path)


def image_base64(content):
    """A binary column as base64 text."""
    return F.base64(content)


@dataclass(frozen=True)
class Settings:
    """What a deployment sets; read from DIP_* variables, which win over a file of NAME=value lines."""

    api_key: str | None = None
    max_image_bytes: int = 8 * 1024 * 1024
    max_concurrency: int = 8
    request_timeout_s: float = 15.0
    auto_orient: bool = True
    det_max_side: int = 1280
    ocr_backend: str | None = None
    card_detect: bool = True
    corner_fallback: bool = False
    corner_ratio: float = 0.55
    orient_model: bool = False
    orient_threshold: float = 0.75
    allowed_networks: tuple[str, ...] = ("127.0.0.0/8",)

    @classmethod
    def load(cls, env: dict[str, str] | None = None, file: str | None = None) -> Settings:
        found: dict[str, str] = {}
        if file and os.path.exists(file):
            with open(file, encoding="utf-8") as lines:
                found |= {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if "=" in x and not x.lstrip().startswith("#"))}
        found |= dict(os.environ if env is None else env)
        given = {}
        for f in fields(cls):
            raw = found.get("DIP_" + f.name.upper())
            if raw is None:
                continue
            default = f.default
            if isinstance(default, bool):
                given[f.name] = raw.lower() in ("1", "true", "yes")
            elif isinstance(default, (int, float)):
                given[f.name] = type(default)(raw)
            elif isinstance(default, tuple):
                given[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            else:
                given[f.name] = raw
        return cls(**given)
