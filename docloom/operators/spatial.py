"""Label matching, neighbour lines and single ways of finding a value, without regard to what other fields took.

These are the extractor's own questions, asked one at a time of every document. As higher-order
Column functions they were measured at over a minute for 1 500 documents (lambdas are interpreted,
and what they name is computed anew each time); as an Arrow kernel over nested lines they need no
shuffle either and take a second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from docloom.functions.pytext import key, post_process
from docloom.operators.extract import LINES, TAKES, Found, Page, prefix_span, read_line
from docloom.shipping import ship
from docloom.sources.rules import FieldRule


def per_document(docs: DataFrame, schema: str, labels: Iterable[str], answer: Callable[[Page], list[tuple]]) -> DataFrame:
    """docs(doc_id, lines) -> for each document the rows that `answer` gives for its page, after its doc_id."""
    ship(docs.sparkSession)
    keys = [k for k in map(key, labels) if k]
    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for doc_id, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page([read_line(o["line_no"], o) for o in lines or () if o is not None], keys)
                for row in answer(page):
                    ids.append(doc_id)
                    rows.append(row)
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *columns], ["doc_id", *names])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("lines").cast(LINES).alias("lines")).mapInArrow(run, f"doc_id {doc_id}, {schema}")


def label_spans(docs: DataFrame, labels: Iterable[str]) -> DataFrame:
    """(doc_id, line_no, span): how many words at each line's beginning make the first fitting label up; 0 if none does."""
    keys = [k for k in map(key, labels) if k]

    def answer(page: Page) -> list[tuple]:
        return [(line.no, next((n for n in (prefix_span(line.tokens, 0, k) for k in keys) if n), 0)) for line in page.lines]

    return per_document(docs, "line_no int, span long", labels, answer)


def _rule(labels: Iterable[str], **more) -> FieldRule:
    return FieldRule("value", tuple(labels), **more)


def right_neighbours(docs: DataFrame, labels: Iterable[str], vietnamese: bool = False) -> DataFrame:
    """(doc_id, line_no, text) of the line to the right of the label's."""
    rule = _rule(labels)

    def answer(page: Page) -> list[tuple]:
        found = page.find_label(rule)
        near = page.neighbour(found[0], vietnamese) if found else None
        return [(near.no, near.text)] if near else []

    return per_document(docs, "line_no int, text string", (), answer)


def lines_below(docs: DataFrame, labels: Iterable[str], all_labels: Iterable[str]) -> DataFrame:
    """(doc_id, line_no, text) of the line under the label's, in its own column."""
    rule = _rule(labels)

    def answer(page: Page) -> list[tuple]:
        found = page.find_label(rule)
        near = page.below(found[0], found[0].x, found[0].x2) if found else None
        return [(near.no, near.text)] if near else []

    return per_document(docs, "line_no int, text string", all_labels, answer)


def values(docs: DataFrame, rules: dict[str, FieldRule], all_labels: Iterable[str] = ()) -> DataFrame:
    """A row for each document with what each rule's take finds on the whole page; null if nothing."""

    def answer(page: Page) -> list[tuple]:
        found: list[Found | None] = [TAKES[r.take](page, r) for r in rules.values()]
        return [tuple(f.text if f else None for f in found)]

    return per_document(docs, ", ".join(f"{name} string" for name in rules), all_labels, answer)


def by_pattern(docs: DataFrame, rule: FieldRule) -> DataFrame:
    """(doc_id, value): the first line, or word of a line, that is what the rule's pattern asks for."""

    def answer(page: Page) -> list[tuple]:
        pattern = rule.pattern
        if pattern is None:
            return []
        for line in page.lines:
            for text in (line.text, *line.text.split()):
                value = post_process(text, rule.type, rule.normalize)
                if value and pattern.fullmatch(value):
                    return [(value,)]
        return []

    return per_document(docs, "value string", (), answer)
