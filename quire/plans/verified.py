"""Export of a form whose grid is known, with checks: a CSV a page, one of all pages, and the figures that were checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import grids
from quire.operators.layout import PAGE
from quire.sources import sinks

# Headers of the form's columns, and of the page and row before them in the file of all pages.
HEADERS = ("Item", "Año", "Descripción", "Acuerdo", "Otorgante", "Copartícipes", "Porcentual Ad-valorem", "Residual Ad-valorem", "Observaciones", "Observaciones de Cronograma", "Columna sin encabezado")
INDEX = ("Página PDF", "Fila en página")


def _row(*cells: str):
    return F.array(F.array(*(F.lit(c) for c in cells)))


def export(objects: DataFrame, folder: str, form: grids.Form | None = None, headers: tuple[str, ...] = HEADERS) -> list[str]:
    """Paths of the files written for each document of layout objects; fails, before anything is written, if a check of a page does."""
    pages = grids.verified(objects.where("kind <> 'error'"), form).persist()
    wrong = pages.agg(F.min(F.when(F.col("error").isNotNull(), F.struct(*PAGE, "error")))).collect()[0][0]
    if wrong:
        pages.unpersist()
        raise ValueError(f"{wrong['doc_id']}, page {wrong['page_no']}: {wrong['error']}")
    stem = X.stem(F.col("doc_id"))
    each = pages.select(F.concat(stem, F.format_string("-csv/page-%03d.csv", "page_no")).alias("file_name"), F.concat(_row(*headers), "rows").alias("rows"))
    indexed = F.transform("rows", lambda r, i: F.concat(F.array(F.col("page_no").cast("string"), (i + 1).cast("string")), r))
    docs = pages.withColumn("_r", indexed).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "_r", F.struct(F.col("page_no").alias("page"), F.size("rows").alias("rows"), "item_codes", "characters").alias("_p")))).alias("l"))
    whole = docs.select(F.concat(stem, F.lit("-csv/"), stem, F.lit(".csv")).alias("file_name"), F.concat(_row(*INDEX, *headers), F.flatten(F.transform("l", lambda x: x["_r"]))).alias("rows"))
    figures = docs.select(F.concat(stem, F.lit("-csv/validation.json")).alias("file_name"), F.to_json(F.struct(F.col("doc_id").alias("source"), F.transform("l", lambda x: x["_p"]).alias("pages"), F.aggregate("l", F.lit(0), lambda a, x: a + x["_p"]["rows"]).alias("total_rows"))).alias("json"))
    out = [r[0] for r in sinks.write_csv_tables(each.unionByName(whole), folder).collect()] + [r[0] for r in sinks.write_files(figures, folder, "file_name", "json").collect()]
    pages.unpersist()
    return sorted(out)
