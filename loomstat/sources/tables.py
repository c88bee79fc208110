"""Tables in and out: CSV, Parquet, report folders and workbooks."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from loomstat.operators.layout import quoted


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table with a header; types are inferred (a second pass) unless a schema is given."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", False)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def sidecar_catalog(spark: SparkSession, table_path: str, name: str = "features_catalog.csv") -> DataFrame | None:
    """The catalog beside a table, on whatever file system the table is on; None if there is none."""
    at = f"{os.path.dirname(table_path.rstrip('/'))}/{name}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return read_csv(spark, at) if found else None


def write_csv(df: DataFrame, path: str, single: bool = False) -> str:
    """A folder of CSV parts; one part if ``single``, which is for tables of results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_report(sheets: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One CSV folder per sheet; names that begin with _ are not exported."""
    return {name: write_csv(df, f"{folder}/{name}", True) for name, df in sheets.items() if not name.startswith("_")}


#: Columns of the manifest of a split; lists are joined by semicolons.
MANIFEST = ("input_table", "stripped_table", "removed_table", "input_catalog", "stripped_catalog", "removed_catalog", "features", "configs", "families", "family_groups", "metadata_columns", "removed_columns", "unmatched_selectors", "n_kept_columns", "n_removed_columns")


def split_to_files(spark: SparkSession, table_path: str, folder: str, selectors, catalog: DataFrame | str | None = None) -> dict[str, str]:
    """Read a table, split it by selectors, write kept and removed columns, catalogs (of the one given, or its path, or
    that beside the table) and a manifest."""
    from loomstat.operators.catalogs import FeatureCatalog
    from loomstat.operators.selectors import split_table

    df = read_csv(spark, table_path)
    catalog_path = catalog if isinstance(catalog, str) else None
    catalog = read_csv(spark, catalog) if catalog_path else catalog if catalog is not None else sidecar_catalog(spark, table_path)
    known = FeatureCatalog(catalog) if catalog is not None else None
    split = split_table(df, selectors, known.rows() if known else None, catalog_df=known.frame if known else None)
    out = {"kept": write_csv(split.kept, f"{folder}/kept"), "removed": write_csv(split.removed, f"{folder}/removed")}
    for name in ("kept_catalog", "removed_catalog"):
        if (part := getattr(split, name)) is not None:
            out[name] = write_csv(part, f"{folder}/{name}", True)
    joined = lambda names: ";".join(names)
    paths = (table_path, out["kept"], out["removed"], catalog_path, out.get("kept_catalog"), out.get("removed_catalog"))
    asked = (joined(selectors.features), joined(selectors.configs), joined(selectors.families), joined(selectors.family_groups))
    row = (*paths, *asked, joined(split.metadata_columns), joined(split.removed_columns), joined(split.unmatched), len(split.kept_columns), len(split.removed_columns))
    rows = spark.createDataFrame([row], ", ".join(f"{n} {'long' if n.startswith('n_') else 'string'}" for n in MANIFEST))
    out["manifest"] = write_csv(rows, f"{folder}/manifest", True)
    return out


def small_as_scientific(parts: tuple[str, ...], others: tuple[tuple[tuple[str, ...], str], ...], rest: str) -> Callable[[str, float], str]:
    """A number format by column: four places, or scientific below 1e-4, where a name has one of ``parts``; else the format
    of the first of ``others`` that the name has a part of, or ``rest``."""

    def form(column: str, value: float) -> str:
        if any(p in column for p in parts):
            return "0.00E+00" if value < 1e-4 else "0.0000"
        return next((f for names, f in others if any(n in column for n in names)), rest)

    return form


REPRODUCIBILITY = small_as_scientific(("p_value", "p_fdr"), ((("ms_", "f_stat"), "0.00"),), "0.000")
BATCH_EFFECTS = small_as_scientific(("_p", "_q"), ((("variance", "missing", "eta"), "0.000"),), "0.00")
ASSOCIATIONS = small_as_scientific(("p_value", "p_fdr"), (), "0.000")


def _cell(ref: str, value, style: int) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) != float("inf"):
        return f'<c r="{ref}" s="{style}"><v>{value!r}</v></c>'
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(sheets: dict[str, DataFrame], path: str, number_format: Callable[[str, float], str | None] = ASSOCIATIONS, most_rows: int = 1_048_575) -> str:
    """An .xlsx file with a sheet per result: bold frozen header, filter, columns as wide as their longest value,
    ``feature`` in bold, and numbers as ``number_format`` of their column and value says.

    Results are per feature and small; a sheet of more than ``most_rows`` is an error, as the format allows no more."""
    codes: dict[str, int] = {}  # number formats by code; two styles come before theirs

    def style(column: str, value) -> int:
        if column == "feature":
            return 1
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or abs(value) == float("inf"):
            return 0
        code = number_format(column, float(value))
        return 0 if code is None else 2 + codes.setdefault(code, len(codes))

    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = [n for n in sheets if not n.startswith("_")]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, name in enumerate(names, 1):
            df = sheets[name]
            rows = df.limit(most_rows + 1).collect()
            if len(rows) > most_rows:
                raise ValueError(f"{name} has more rows than a sheet holds")
            body = ["".join(f'<c r="{_letters(j)}1" s="1" t="inlineStr"><is><t>{escape(c)}</t></is></c>' for j, c in enumerate(df.columns))]
            body += ["".join(_cell(f"{_letters(j)}{r}", v, style(c, v)) for j, (c, v) in enumerate(zip(df.columns, row))) for r, row in enumerate(rows, 2)]
            wide = [max([len(c), *(len(shown(row[j])) for row in rows)]) for j, c in enumerate(df.columns)]
            cols = "".join(f'<col min="{j}" max="{j}" width="{max(w + 4, 11)}" customWidth="1"/>' for j, w in enumerate(wide, 1))
            data = "".join(f'<row r="{r}">{x}</row>' for r, x in enumerate(body, 1))
            last = f"{_letters(max(len(df.columns) - 1, 0))}{len(rows) + 1}"
            view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}">{view}<cols>{cols}</cols><sheetData>{data}</sheetData><autoFilter ref="A1:{last}"/></worksheet>')
        tabs = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{tabs}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        links += f'<Relationship Id="rId{len(names) + 1}" Type="{rel}/styles" Target="styles.xml"/>'
        package = "http://schemas.openxmlformats.org/package/2006"
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        own = "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{escape(code)}"/>' for code, i in codes.items())
        own = f'<numFmts count="{len(codes)}">{own}</numFmts>' if codes else ""
        cells = "".join(f'<xf numFmtId="{164 + i}" applyNumberFormat="1"/>' for i in range(len(codes)))
        styles = f'{own}<fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{2 + len(codes)}"><xf/><xf fontId="1" applyFont="1"/>{cells}</cellXfs>'
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}">{styles}</styleSheet>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        base = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{base}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{base}.styles+xml"/>{kinds}</Types>')
    return path


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*map(quoted, names))
