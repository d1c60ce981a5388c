"""Raw feeds parsed by an error-recovering recursive-descent grammar.

Two grammars: lines of a label file and records of the split manifest (comma-separated, double quotes). Each
rule is a method that consumes input at a position and returns a value or raises ``SyntaxProblem`` with its place.
After a broken quote the parser goes on at the next validated record start. Where the rows of a table are the records,
the starts are those of the rows: the records of a batch are one feed whose starts are known. In a feed without rows a start is
a physical line whose first field is a known dataset and whose second field looks like an image path, or that has the
fields of a record with most of its fixed words. So one broken quote costs the record it is in and not the rest of the
feed. Lines between it and the next start can't be told from what an open quote holds: each comes out as a
``skipped_line`` with its place if ``skipped`` is asked for.

The parsers run over Arrow batches; no shuffle is needed. Typed records and located problems come out in one pass.
``read_manifest_feed`` reads whole files of any size: their blocks are parsed where they are read, and only what lies
between the ends of two blocks, from the last record start of one to the first of the next, is put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Scratch

# The vocabularies of the manifest.
DATASETS = ("aadhaar", "pan", "driving_license")
SPLITS = ("train", "valid", "test")
METHODS = ("roboflow_source_stem", "exact_byte_duplicate", "near_duplicate", "single_source")
CONFIDENCES = ("high", "possible", "unmatched")
MANIFEST = (
    "dataset", "image_rel_path", "filename", "raw_split", "target_split", "source_group_id", "grouping_method",
    "confidence", "sha256", "dhash", "width", "height", "annotation_count", "notes",
)
#: A coordinate may leave [0, 1] by this much.
EPS = 1e-6

NUMBER = re.compile(r"[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF])")
HEX64 = re.compile(r"[0-9a-fA-F]{64}")
HEX16 = re.compile(r"(?:[0-9a-fA-F]{16})?")
DIGITS = re.compile(r"[0-9]+")
TOKEN = re.compile(r"\S+")
LINE = re.compile(r"[^\n]+")
BARE = re.compile(r'[^",]*')
BARE_IN_LINE = re.compile(r'[^",\r\n]*')
QUOTED = re.compile(r'"([^"]*(?:""[^"]*)*)"')
ANCHOR = re.compile(r'(?:^|(?<=\n))"?(?:' + "|".join(DATASETS) + r')"?,"?[^",\r\n]*/images/[^",\r\n]+"?,')
#: The first fields of a record, all on one line, each with its comma.
LINE_START = re.compile(r"(?:^|(?<=[\r\n]))(?=[^\r\n])")
IN_LINE = r'(?:"(?:[^"\r\n]|"")*"|[^",\r\n]*),'
HEAD = re.compile(IN_LINE * (len(MANIFEST) - 1))
HEAD_FIELD = re.compile(IN_LINE)


class SyntaxProblem(Exception):
    """``code`` at character ``at`` of the text."""

    def __init__(self, code: str, at: int):
        super().__init__(code)
        self.code, self.at = code, at


class LabelLine:
    """line := class_id (box | polygon); tokens are separated by white space."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = text.split()

    def parse(self) -> dict | None:
        """An annotation, or None for a line without tokens."""
        if not self.tokens:
            return None
        values = [self.number(i, t) for i, t in enumerate(self.tokens)]
        class_id = self.class_id(values[0])
        coords = values[1:]
        shape = self.box if len(coords) == 4 else self.polygon
        return {"class_id": class_id, **shape(coords)}

    def _at(self, i: int) -> int:
        """Where token ``i`` begins."""
        return next(islice(TOKEN.finditer(self.text), i, None)).start()

    def number(self, i: int, token: str) -> float:
        if not NUMBER.fullmatch(token):
            raise SyntaxProblem("malformed_line", self._at(i))
        return float(token)

    def class_id(self, value: float) -> int:
        if not value.is_integer() or value < 0:
            raise SyntaxProblem("invalid_class_id", self._at(0))
        return int(value)

    def box(self, c: list[float]) -> dict:
        if c[2] <= 0 or c[3] <= 0:
            raise SyntaxProblem("zero_or_negative_size", self._at(3 if c[2] <= 0 else 4))
        self.inside(c)
        return {"kind": "bbox", "coords": c}

    def polygon(self, c: list[float]) -> dict:
        if len(c) < 6 or len(c) % 2:
            raise SyntaxProblem("invalid_token_count", len(self.text))
        self.inside(c)
        return {"kind": "polygon", "coords": c}

    def inside(self, c: list[float]) -> None:
        for i, v in enumerate(c):
            if v < -EPS or v > 1 + EPS:
                raise SyntaxProblem("coord_out_of_range", self._at(i + 1))


_WORDS = (("dataset", DATASETS), ("raw_split", SPLITS), ("target_split", SPLITS), ("grouping_method", METHODS), ("confidence", CONFIDENCES))
_SHAPES = (("sha256", HEX64), ("dhash", HEX16), ("width", DIGITS), ("height", DIGITS), ("annotation_count", DIGITS))


def record_start(text: str, at: int = 0) -> bool:
    """Whether a record begins at ``at``, the start of a line: with a dataset and an image path, or with as many fields as
    a record has, most of those with a fixed vocabulary from it, whatever its dataset and path are."""
    if ANCHOR.match(text, at):
        return True
    head = HEAD.match(text, at)
    if not head:
        return False
    f = dict(zip(MANIFEST, (x[:-1].strip('"') for x in HEAD_FIELD.findall(head[0]))))
    return sum(f[k] in v for k, v in _WORDS) >= 3


class Manifest:
    """feed := record (newline record)*; record := field ("," field)*; field := quoted | bare.

    ``starts``: where records are known to begin; each ends a character before the next begins, and its bare fields may
    hold line breaks. Without, every line may begin a record, and validated starts are looked for after broken quotes.
    """

    def __init__(self, text: str, starts: list[int] | None = None, skipped: bool = False):
        self.text, self.starts, self.skipped = text, starts, skipped
        self.at, self.end = 0, len(text)

    def feed(self) -> Iterator[tuple[int, dict | SyntaxProblem]]:
        """``(start, record or problem)`` of each record; after broken quoting the next validated start is resumed at."""
        return self.known() if self.starts is not None else self.found()

    def known(self) -> Iterator[tuple[int, dict | SyntaxProblem]]:
        for start, after in zip(self.starts, [*self.starts[1:], len(self.text) + 1]):
            self.at, self.end = start, after - 1
            if self.end > start and self.text[self.end - 1] == "\r":  # a carriage return at the very end is no content
                self.end -= 1
            yield start, self.outcome(start)

    def found(self) -> Iterator[tuple[int, dict | SyntaxProblem]]:
        while True:
            start = self.at
            one = self.outcome(start)
            yield start, one
            if isinstance(one, SyntaxProblem) and one.code == "broken_quoting":
                after = self.anchor(one.at + 1)
                if self.skipped:
                    for m in LINE.finditer(self.text, self._next_line(one.at), self.end if after is None else after):
                        if m[0].strip("\r"):
                            yield m.start(), SyntaxProblem("skipped_line", m.start())
                if after is None:
                    return
                self.at = after
                continue
            if self.at >= self.end:
                return
            self.newline()
            if self.at >= self.end:
                return

    def _next_line(self, at: int) -> int:
        i = self.text.find("\n", at)
        return self.end if i < 0 else i + 1

    def outcome(self, start: int) -> dict | SyntaxProblem:
        try:
            return self.typed(self.record(), start)
        except SyntaxProblem as e:
            return e

    def anchor(self, at: int) -> int | None:
        """The next line that begins like a record."""
        return next((m.start() for m in LINE_START.finditer(self.text, at) if record_start(self.text, m.start())), None)

    def newline(self) -> None:
        self.at += 2 if self.text.startswith("\r\n", self.at) else 1

    def record(self) -> list[str]:
        fields = [self.field()]
        while self.text.startswith(",", self.at, self.end):
            self.at += 1
            fields.append(self.field())
        return fields

    def field(self) -> str:
        start = self.at
        value = self.quoted() if self.text.startswith('"', self.at, self.end) else self.bare()
        if self.at < self.end and self.text[self.at] != "," and (self.starts is not None or self.text[self.at] not in "\r\n"):
            raise SyntaxProblem("broken_quoting", start)  # a quote left open may have run on over later records
        return value

    def quoted(self) -> str:
        m = QUOTED.match(self.text, self.at, self.end)
        if not m:
            raise SyntaxProblem("broken_quoting", self.at)
        self.at = m.end()
        return m[1].replace('""', '"')

    def bare(self) -> str:
        m = (BARE_IN_LINE if self.starts is None else BARE).match(self.text, self.at, self.end)
        self.at = m.end()
        return m[0]

    def typed(self, f: list[str], start: int) -> dict:
        if len(f) != len(MANIFEST):
            raise SyntaxProblem("column_count", start)
        r = dict(zip(MANIFEST, f))
        if any(r[k] not in v for k, v in _WORDS) or any(not v.fullmatch(r[k]) for k, v in _SHAPES):
            raise SyntaxProblem("invalid_value", start)
        bits = int(r["dhash"], 16) if r["dhash"] else None
        r["dhash"] = bits if bits is None or bits < 1 << 63 else bits - (1 << 64)
        return r | {k: int(r[k]) for k in ("width", "height", "annotation_count")}


def _place(text: str, at: int) -> tuple[int, int]:
    """Line and column, from 1."""
    return text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1


PROBLEM = "row_id BIGINT, problem STRING, line INT, col INT, at BIGINT"
ANNOTATION = f"{PROBLEM}, class_id DECIMAL(38,0), kind STRING, coords ARRAY<DOUBLE>"
RECORD = f"{PROBLEM}, " + ", ".join(f"{c} {'BIGINT' if c == 'dhash' else 'DECIMAL(38,0)' if c in ('width', 'height', 'annotation_count') else 'STRING'}" for c in MANIFEST)
_BIG = pa.decimal128(38, 0)
_LIMIT = 10**38


def _batch(rows: list[dict], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in types.items()], names=list(types))


_PLACES = {"row_id": pa.int64(), "problem": pa.string(), "line": pa.int32(), "col": pa.int32(), "at": pa.int64()}
_ANNOTATION = _PLACES | {"class_id": _BIG, "kind": pa.string(), "coords": pa.list_(pa.float64())}
_RECORD = _PLACES | {c: pa.int64() if c == "dhash" else _BIG if c in ("width", "height", "annotation_count") else pa.string() for c in MANIFEST}


def _problem(row_id: int | None, text: str, e: SyntaxProblem) -> dict:
    line, col = _place(text, e.at)
    return {"row_id": row_id, "problem": e.code, "line": line, "col": col, "at": e.at}


def _held(record: dict, *numbers: str) -> dict:
    """The record with null for numbers that no column holds."""
    return record | {k: None for k in numbers if record[k] >= _LIMIT}


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for row_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                if one := LabelLine(raw or "").parse():
                    rows.append({"row_id": row_id, **_held(one, "class_id")})
            except SyntaxProblem as e:
                rows.append(_problem(row_id, raw, e))
        yield _batch(rows, _ANNOTATION)


_COUNTS = ("width", "height", "annotation_count")


def _parsed(row_id: int | None, text: str, skipped: bool) -> Iterator[dict]:
    for _, x in Manifest(text, None, skipped).feed():
        yield _problem(row_id, text, x) if isinstance(x, SyntaxProblem) else {"row_id": row_id, **_held(x, *_COUNTS)}


def _record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch as one feed whose record starts are known."""
    for b in batches:
        raws = [x or "" for x in b.column(1).to_pylist()]
        starts = list(accumulate((len(x) + 1 for x in raws[:-1]), initial=0))
        rows = []
        for row_id, raw, (start, x) in zip(b.column(0).to_pylist(), raws, Manifest("\n".join(raws), starts).feed()):
            rows.append(_problem(row_id, raw, SyntaxProblem(x.code, x.at - start)) if isinstance(x, SyntaxProblem) else {"row_id": row_id, **_held(x, *_COUNTS)})
        yield _batch(rows, _RECORD)


def _feed_batches(skipped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([r for row_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in _parsed(row_id, raw or "", skipped)], _RECORD)

    return run


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """Of ``lines (row_id, raw)``, one row for each line with tokens: a typed annotation with ``problem`` null, or
    the first problem with its place and no values. Lines without tokens and null lines give no row. Repeated
    rows are parsed each. A class id of 10^38 or more is a whole number, so its line loads, but no column holds it: it is null."""
    return lines.select("row_id", "raw").mapInArrow(_label_batches, ANNOTATION)


def parse_manifest(rows: DataFrame, one_record: bool = True, skipped: bool = False) -> DataFrame:
    """Of ``rows (row_id, raw)``, one row for each record: typed with ``problem`` null, or the first problem with
    its place. ``one_record``: each ``raw`` is one record (a null or empty one has one empty field, so the wrong
    column count); otherwise ``raw`` is a feed of many records, one per line, and parsing resumes at the next
    validated record start after broken quotes; with ``skipped`` every line passed over then is a row as well. Counts of
    10^38 or more are null, as no column holds them."""
    return rows.select("row_id", "raw").mapInArrow(_record_batches if one_record else _feed_batches(skipped), RECORD)


FEED = RECORD.replace("row_id BIGINT", "file STRING, piece BIGINT", 1)
_FEED = {"file": pa.string(), "piece": pa.int64()} | {k: v for k, v in _RECORD.items() if k != "row_id"}


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``(value, file, block)``, in order within a block, to parsed records of what lies between the first and the last
    record start of each block, and to the text before (part 0) and after (part 1) as rows of ``edge``."""

    def done(at: tuple, head: list[str], body: list[str], last: int) -> Iterator[pa.RecordBatch]:
        file, block = at
        edges = [(0, "\n".join(head))] if head else []
        if body:
            edges.append((1, "\n".join(body[last:])))
            text = "\n".join(body[:last])
            rows = [{**r, "file": file, "piece": block} for r in _parsed(None, text, True)] if text else []
        else:
            rows = []
        rows += [{"file": file, "piece": block, "part": k, "edge": x} for k, x in edges]
        yield _batch(rows, _FEED | {"part": pa.int32(), "edge": pa.string()})

    at, head, body, last = None, [], [], 0
    for b in batches:
        for value, file, block in zip(*(c.to_pylist() for c in b.columns)):
            if (file, block) != at:
                if at:
                    yield from done(at, head, body, last)
                at, head, body, last = (file, block), [], [], 0
            if record_start(value):
                last = len(body)
                body.append(value)
            else:
                (body if body else head).append(value)
    if at:
        yield from done(at, head, body, last)


def _joined_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for file, piece, text in zip(*(c.to_pylist() for c in b.columns)):
            rows += [{**r, "file": file, "piece": piece} for r in _parsed(None, text, True)]
        yield _batch(rows, _FEED)


def read_manifest_feed(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """``(file, piece, problem, line, col, at, fields of the record)`` of the records in the text files at ``path``.

    Files of any size are read by blocks. A block's text from its first to its last record start is parsed in the task that reads it;
    the text after the last one is put before that of the next block up to its first one, which moves at most two pieces
    per block. Places are within the piece, which begins in the block at byte ``piece`` of the file. Every physical line comes
    out in a record, in a problem, or as a ``skipped_line`` after a broken quote. A line that begins like a record is believed to
    be one at the end of a block, even within quotes. A file without a record start is one piece."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    cut = scratch.keep(lines.mapInArrow(_cut_blocks, f"{FEED}, part INT, edge STRING"), "blocks")
    own = Window.partitionBy("file").orderBy("piece", "part")
    edges = cut.where("part is not null").select("file", "piece", "part", "edge").withColumn("g", F.sum("part").over(own))
    text = edges.groupBy("file", "g").agg(F.min("piece").alias("piece"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "part", "edge"))), lambda x: x["edge"]), "\n").alias("text"))
    return cut.where("part is null").drop("part", "edge").unionByName(text.select("file", "piece", "text").mapInArrow(_joined_edges, FEED))
