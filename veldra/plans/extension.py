"""Extension points: inspectors of label formats, and models and converters as functions over DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..operators import conversion, documents, labels


class LabelInspector(ABC):
    @abstractmethod
    def can_inspect(self, lines: DataFrame) -> bool:
        """Whether the lines have this format."""

    @abstractmethod
    def inspect(self, lines: DataFrame) -> DataFrame:
        """The lines with ``issues``, ``kept``, ``kind`` and ``class_id``."""


class TextLineInspector(LabelInspector):
    """Class id and coordinates separated by white space."""

    def can_inspect(self, lines: DataFrame) -> bool:
        t = labels.tokenize(lines)
        n = t.selectExpr("count(*) AS n", "count_if(v IS NULL OR size(v) < 5 OR isnan(v[0]) OR v[0] <> floor(v[0])) AS bad").first()
        return n.n > 0 and n.bad == 0

    def inspect(self, lines: DataFrame) -> DataFrame:
        return labels.with_issues(lines)


_INSPECTORS: list[LabelInspector] = [TextLineInspector()]


def register_inspector(inspector: LabelInspector) -> None:
    """Inspectors are asked in the order of registration; the first that can is taken."""
    _INSPECTORS.append(inspector)


def inspector_for(lines: DataFrame) -> LabelInspector | None:
    return next((i for i in _INSPECTORS if i.can_inspect(lines)), None)


#: Rows in, rows out: a detector gives regions of images, a recogniser texts of crops, a classifier a type.
BatchModel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
Extractor = Callable[[DataFrame], DataFrame]
Validator = Callable[[Column], Column]


class Detector(ABC):
    """Rows of images in, rows of regions out; ``schema`` is that of what comes out. At most ``max_regions`` of an image are kept,
    the most confident ones, which is a setting of the detector."""

    schema: str
    max_regions: int = 300

    @abstractmethod
    def detect(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]: ...

    def regions(self, images: DataFrame, doc: str = "doc_id") -> DataFrame:
        """``(doc, idx, det, ...)`` with ``idx`` from 0 in falling confidence."""
        found = images.mapInArrow(self.detect, self.schema)
        w = Window.partitionBy(doc).orderBy(F.desc("det"), "idx")
        return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= self.max_regions).withColumn("idx", (F.col("_n") - 1).cast(found.schema["idx"].dataType)).drop("_n")


class Recognizer(ABC):
    """Rows of regions in, the same rows with texts out. ``normalize`` is applied to the text in the JVM."""

    schema: str

    @abstractmethod
    def recognize(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]: ...

    def normalize(self, text: Column) -> Column:
        return strip(text)

    def texts(self, regions: DataFrame) -> DataFrame:
        return regions.mapInArrow(self.recognize, self.schema).withColumn("text", self.normalize(F.col("text")))


class Classifier(ABC):
    @abstractmethod
    def classify(self, texts: DataFrame, doc: str = "doc_id") -> DataFrame:
        """``(doc, document_type, score, issue)``."""


class FieldClassifier(Classifier):
    """The type whose exclusive fields were detected with most confidence."""

    def classify(self, texts: DataFrame, doc: str = "doc_id") -> DataFrame:
        return documents.infer_type(texts, documents.exclusive_fields(), doc)


class FieldExtractor(ABC):
    @abstractmethod
    def extract(self, texts: DataFrame, types: DataFrame, doc: str = "doc_id") -> DataFrame:
        """``(doc, document_type, field, value, ...)``."""


class BestRegionExtractor(FieldExtractor):
    """The best region of each field of the document's type; a field without one is null."""

    def extract(self, texts: DataFrame, types: DataFrame, doc: str = "doc_id") -> DataFrame:
        fields = documents.best_per_field(texts, sorted({f for v in documents.FIELDS.values() for f in v}), doc)
        vocab = documents.vocabulary_rows(texts.sparkSession).withColumnRenamed("field_name", "field")
        return fields.join(types.select(doc, "document_type"), doc).join(F.broadcast(vocab), ["document_type", "field"], "left_semi")


class DocumentValidator(ABC):
    @abstractmethod
    def problems(self, fields: Column, today: Column) -> Column:
        """Codes for a map of field to value."""


class NumberedDocument(DocumentValidator):
    """Types with a number and a date of birth."""

    def __init__(self, kind: str):
        self.kind = kind

    def problems(self, fields: Column, today: Column) -> Column:
        return documents.document_problems(fields, self.kind, today)


class DatasetConverter(ABC):
    @abstractmethod
    def convert(self, images: DataFrame, lines: DataFrame) -> DataFrame:
        """One document per image, failures as rows with an error."""


class LineConverter(DatasetConverter):
    """Class id and coordinates per line, by a mapping of classes to fields."""

    def __init__(self, mapping: DataFrame, manifest: DataFrame | None = None):
        self.mapping, self.manifest = mapping, manifest

    def convert(self, images: DataFrame, lines: DataFrame) -> DataFrame:
        return conversion.convert_documents(images, lines, self.mapping, self.manifest)


#: Types that are validated by default; others have no rules.
VALIDATORS: dict[str, DocumentValidator] = {k: NumberedDocument(k) for k in ("aadhaar", "pan")}


def validate(fields: DataFrame, validators: dict[str, DocumentValidator] | None = None, doc: str = "doc_id", today: Column | None = None) -> DataFrame:
    """``(doc, code)`` of extracted ``fields (doc, document_type, field, value)`` by the validator of each document's type. A field that
    isn't among a document's rows wasn't looked for, one with a null value wasn't found."""
    rules = VALIDATORS if validators is None else validators
    g = fields.groupBy(doc, "document_type").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    codes = F.array().cast("array<string>")
    for kind, v in rules.items():
        codes = F.when(F.col("document_type") == kind, v.problems(F.col("m"), F.current_date() if today is None else today)).otherwise(codes)
    return g.select(doc, F.explode(codes).alias("code"))


def run(images: DataFrame, detector: Detector, recognizer: Recognizer, classifier: Classifier | None = None, extractor: FieldExtractor | None = None, validators: dict[str, DocumentValidator] | None = None, doc: str = "doc_id") -> dict[str, DataFrame]:
    """Images to validated fields: ``texts``, ``types``, ``fields``, ``issues (doc, field, issue)`` and ``problems (doc, code)``. Nothing
    runs until one of them is used."""
    texts = recognizer.texts(detector.regions(images, doc))
    types = (classifier or FieldClassifier()).classify(texts, doc)
    own = (extractor or BestRegionExtractor()).extract(texts, types, doc)
    return {"texts": texts, "types": types, "fields": own, "issues": documents.field_issues(texts, types.select(doc, "document_type"), doc), "problems": validate(own, validators, doc)}


def run_pipeline(images: DataFrame, detect: BatchModel, recognize: BatchModel, region_schema: str, text_schema: str, doc: str = "doc_id") -> dict[str, DataFrame]:
    """Images to fields: the detector finds regions, the recogniser reads them, the type is inferred, and the best
    region of each field is taken. Models run in Arrow batches; everything else is relational. ``region_schema`` and
    ``text_schema`` are those of what the models return; the latter has ``doc_id, idx, field, text, det, rec``."""
    regions = images.mapInArrow(detect, region_schema)
    texts = regions.mapInArrow(recognize, text_schema)
    types = documents.infer_type(texts, documents.exclusive_fields(), doc)
    fields = documents.best_per_field(texts, sorted({f for v in documents.FIELDS.values() for f in v}), doc)
    vocab = documents.vocabulary_rows(images.sparkSession).withColumnRenamed("field_name", "field")
    own = fields.join(types.select(doc, "document_type"), doc).join(vocab, ["document_type", "field"], "left_semi")
    return {"types": types, "fields": own, "issues": documents.field_issues(texts, types.select(doc, "document_type"), doc), "problems": validate(own, doc=doc)}
