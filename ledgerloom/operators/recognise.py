"""Recognition and any other engine over a table of contents, as a table function for SQL: the engine is an argument."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, Row, StringType, StructField, StructType

#: From contents to lines: (polygon, text, confidence).
Engine = Callable[[bytes], list[tuple[list[list[float]], str, float]]]

_LINE = [StructField("line_no", LongType()), StructField("poly", ArrayType(ArrayType(DoubleType()))), StructField("text", StringType()), StructField("conf", DoubleType()), StructField("error", StringType())]


def register_engines(spark: SparkSession, engines: dict[str, Callable[[], Engine]], name: str = "recognise", content: str = "content") -> None:
    """Makes `SELECT * FROM recognise(TABLE(files), engine => 'one')` work in this session.

    The function gives the table's other columns, then line_no, poly, text, conf
    and error: a row for each line with text. An image without such lines has no
    row; one that the engine fails on has one row with the error. `engines` make
    an engine by name, once in each task; a name that isn't among them, and a
    table without contents, are errors when the query is analysed. A null
    content has no lines.
    """

    class Recognise:
        def __init__(self) -> None:
            self.engine: Engine | None = None

        @staticmethod
        def analyze(files: AnalyzeArgument, engine: AnalyzeArgument) -> AnalyzeResult:
            if not files.isTable or content not in files.dataType.names:
                raise ValueError(f"{name} takes a table with a column {content}")
            if engine.value not in engines:
                raise ValueError(f"no engine {engine.value!r}; there are {', '.join(sorted(engines))}")
            kept = [f for f in files.dataType.fields if f.name != content]
            taken = {f.name.lower() for f in kept} & {f.name for f in _LINE}
            if taken:
                raise ValueError(f"{name} makes columns that the table has: {', '.join(sorted(taken))}")
            return AnalyzeResult(StructType([*kept, *_LINE]))

        def eval(self, row: Row, engine: str) -> Iterator[tuple]:
            kept, image = [v for n, v in row.asDict(recursive=False).items() if n != content], row[content]
            if image is None:
                return
            try:
                self.engine = self.engine or engines[engine]()
                lines = self.engine(bytes(image)) or []
            except Exception as problem:  # noqa: BLE001  the image fails, the others go on
                yield (*kept, None, None, None, None, str(problem) or type(problem).__name__)
                return
            for number, (poly, text, conf) in enumerate(lines):
                if text and text.strip():
                    yield (*kept, number, poly, text, conf, None)

    spark.udtf.register(name, udtf(Recognise))
