"""Rules of document types: from the package's own data, or from a folder of manifests; as objects and as small tables.

The tables hold one row for each type, field or code (a few hundred at most by their nature), so
they may be broadcast.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from importlib import resources
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from docloom.functions.pytext import key

log = logging.getLogger(__name__)


@lru_cache(maxsize=4_096)
def compiled(regex: str) -> re.Pattern | None:
    """The pattern, or None where it does not compile: said once in the log."""
    try:
        return re.compile(regex)
    except re.PatternError as bad:
        log.warning("broken pattern %r: %s", regex, bad)
        return None


@dataclass(frozen=True)
class FieldRule:
    name: str
    labels: tuple[str, ...] = ()
    take: str = "after_colon"
    source: tuple[str, ...] = ("ocr",)
    type: str = "text_vi"
    required: bool = False
    regex: str | None = None
    min_len: int | None = None
    enum: tuple[str, ...] = ()
    normalize: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    derive_sex_from: str | None = None
    multiline: bool = False
    compose_from: tuple[str, ...] = ()

    @property
    def pattern(self) -> re.Pattern | None:
        """The compiled regex; None where there is none, or a broken one, which asks for nothing."""
        return compiled(self.regex) if self.regex else None

    @cached_property
    def label_keys(self) -> tuple[str, ...]:
        return tuple(k for k in map(key, self.labels) if k)


@dataclass(frozen=True)
class CodeRule:
    kind: str
    parser: str = ""
    maps_to: tuple[str, ...] = ()
    format: str | None = None


@dataclass(frozen=True)
class DocumentRules:
    doc_type: str
    display_name: str
    version: str = "1.0"
    ready: bool = True
    family: str | None = None
    anchors: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    structured_complete: bool = False
    structured: tuple[CodeRule, ...] = ()
    fields: tuple[FieldRule, ...] = ()
    field_weights: dict[str, float] = field(default_factory=dict)
    cross_checks: tuple[tuple[str, str, str], ...] = ()

    @cached_property
    def all_label_keys(self) -> tuple[str, ...]:
        return tuple(k for f in self.fields for k in f.label_keys)

    def problems(self) -> list[str]:
        """What is wrong with these rules, though they can be used: patterns that do not compile."""
        return [f"{self.doc_type}.{f.name}: broken pattern {f.regex!r}" for f in self.fields if f.regex and f.pattern is None]


@lru_cache(maxsize=1)
def builtin_rules() -> tuple[DocumentRules, ...]:
    import yaml

    text = resources.files("docloom.rules").joinpath("types.yaml").read_text("utf-8")
    return tuple(map(from_manifest, yaml.safe_load(text)))


def from_manifest(raw: dict) -> DocumentRules:
    """From one manifest file's content; only docType, a field's name and a code's kind are mandatory."""
    found, taken = raw.get("classify") or {}, raw.get("extraction") or {}
    rules = []
    for f in taken.get("fields") or ():
        check = f.get("validate") or {}
        rules.append(
            FieldRule(
                name=f["name"], labels=tuple(f.get("labels") or ()), take=f.get("take", "after_colon"), source=tuple(f.get("source", ("ocr",))), type=f.get("type", "text_vi"), required=bool(f.get("required")),
                regex=check.get("regex"), min_len=check.get("minLen"), enum=tuple(check.get("enum") or ()), normalize=tuple(f.get("normalize") or ()), checks=tuple(f.get("checks") or ()),
                derive_sex_from=f.get("deriveSexFromId"), multiline=bool(f.get("multiline")), compose_from=tuple(f.get("composeFrom") or ()),
            )
        )
    codes = tuple(CodeRule(c["kind"], c.get("parser", ""), tuple(c.get("mapsTo") or ()), c.get("format")) for c in raw.get("structuredData") or ())
    kind = raw["docType"]
    weights = (raw.get("confidence") or {}).get("fieldWeights") or {}
    compare = tuple(tuple(c) for c in raw.get("crossChecks") or () if isinstance(c, (list, tuple)) and len(c) == 3)
    return DocumentRules(kind, raw.get("displayName", kind), str(raw.get("version", "1.0")), raw.get("ready", True), raw.get("family"), tuple(found.get("anchors") or ()), tuple(found.get("excludes") or ()), bool(raw.get("structuredComplete")), codes, tuple(rules), dict(weights), compare)


def read_manifests(folder: str | Path) -> tuple[tuple[DocumentRules, ...], dict[str, str]]:
    """(rules in the order of their paths, {path: error} of the manifests that could not be read) below `folder`/*/manifest.yaml.

    A field whose pattern is broken is read without it, as if it had none; `problems` tells of it.
    """
    import yaml

    good, bad = [], {}
    for path in sorted(Path(folder).glob("*/manifest.yaml")):
        try:
            good.append(from_manifest(yaml.safe_load(path.read_text("utf-8"))))
        except Exception as error:
            log.warning("skipped %s: %s", path, error)
            bad[str(path)] = str(error)
    return tuple(good), bad


TYPE_SCHEMA = "doc_type string, display_name string, version string, ready boolean, rank int, family string, anchors array<string>, excludes array<string>, structured_complete boolean, field_weights map<string,double>, cross_checks array<struct<a:string,op:string,b:string>>"
FIELD_SCHEMA = "doc_type string, field_rank int, name string, labels array<string>, label_keys array<string>, take string, source array<string>, type string, required boolean, regex string, min_len int, enum array<string>, normalize array<string>, checks array<string>, derive_sex_from string, multiline boolean, compose_from array<string>"
CODE_SCHEMA = "doc_type string, spec_rank int, kind string, parser string, format string, maps_to array<string>"


def type_table(spark: SparkSession, rules: Iterable[DocumentRules]) -> DataFrame:
    rows = [(r.doc_type, r.display_name, r.version, r.ready, i, r.family, [*map(key, r.anchors)], [*map(key, r.excludes)], r.structured_complete, r.field_weights, list(r.cross_checks)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, TYPE_SCHEMA).coalesce(1)


def field_table(spark: SparkSession, rules: Iterable[DocumentRules]) -> DataFrame:
    rows = [
        (r.doc_type, i, f.name, list(f.labels), list(f.label_keys), f.take, list(f.source), f.type, f.required, f.regex, f.min_len, list(f.enum), list(f.normalize), list(f.checks), f.derive_sex_from, f.multiline, list(f.compose_from))
        for r in rules
        for i, f in enumerate(r.fields)
    ]
    return spark.createDataFrame(rows, FIELD_SCHEMA).coalesce(1)


def code_table(spark: SparkSession, rules: Iterable[DocumentRules]) -> DataFrame:
    rows = [(r.doc_type, i, c.kind, c.parser, c.format, list(c.maps_to)) for r in rules for i, c in enumerate(r.structured)]
    return spark.createDataFrame(rows, CODE_SCHEMA).coalesce(1)
