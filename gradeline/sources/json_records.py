"""Records as JSON: one object per line, or one document made of several arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeline.runtime import settle


def write_json_records(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_json_document(sections: list[tuple[DataFrame, list[str]]], path: str) -> None:
    """Write the document `[[...],[...],...]`, one array per (table, order columns).

    The document is never held in one place. Each section is range-sorted and written as
    text, one record per line, under `path/section=NNN`; the files of all sections, taken
    in name order, are the document. `json_document_paths` lists them in that order.
    """
    last = len(sections) - 1
    for number, (table, order) in enumerate(sections):
        target = f"{path.rstrip('/')}/section={number:03d}"
        open_mark, close_mark = ("[[" if number == 0 else "["), ("]]" if number == last else "],")
        if table.isEmpty():
            marks = table.sparkSession.createDataFrame([(open_mark + close_mark,)], "value string")
            marks.write.text(target)
            continue
        table = settle(table)  # read for its ends, for the sort and for the lines
        # Columns with equal order keys are told apart by their whole row, and copies of one row
        # by nothing: those are an error.
        place = F.struct(*order, F.to_json(F.struct(*table.columns)).alias("__row"))
        ends = F.count_if(place == table.select(F.min(place)).scalar()), F.count_if(place == table.select(F.max(place)).scalar())
        if max(table.agg(*ends).first()) > 1:
            raise ValueError("the first or the last record occurs twice")
        first = table.select(F.min(place)).scalar()
        final = table.select(F.max(place)).scalar()
        opening = F.when(place == first, open_mark).otherwise("")
        closing = F.when(place == final, close_mark).otherwise(",")
        line = F.concat(opening, F.to_json(F.struct(*table.columns)), closing)
        ordered = table.orderBy(*order, F.to_json(F.struct(*table.columns))).select(line.alias("value"))
        ordered.write.text(target)


def json_document_paths(df: DataFrame) -> list[str]:
    """Files behind a `spark.read.text(path)`, in document order."""
    return sorted(p for p in df.inputFiles() if not p.rsplit("/", 1)[-1].startswith("_"))
