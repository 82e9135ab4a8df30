"""Table schemas mined from specification texts, for any number of files in one job.

Input is lines(file, line_no, cells array<string>): the cells of a specification saved as CSV. A title such as
`3. Sales (T_SALES.csv)` opens a table, a row whose first cell is `campo` sets its header, rows below are its
fields; other lines after a title are notes, which may name keys and unique columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Titles and headers are carried forward in runs of so many line numbers.
RUN = 1 << 12
# Fixed values of specifications: the form of a title, type names and their kinds, and words that mark a line as a
# note even if it looks like a field.
TITLE = r"(?i)^\d+\.\s+.*\(T_(.*)\.csv\)"
KINDS = {"Alfanumérico": "string", "Numérico": "integer", "Decimal": "float", "Fecha": "date", "Date": "date", "Booleano": "boolean"}
NOTE_WORDS = ["clave", "unique", "deprecado", "restricción", "formato", "nota", "observación"]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def stripped_cells(lines: DataFrame) -> DataFrame:
    """The lines with trimmed cells, without blank ones."""
    return lines.withColumn("cells", F.transform("cells", trimmed)).where(F.exists("cells", lambda c: c != ""))


def carried(lines: DataFrame, marks: list[str]) -> DataFrame:
    """The lines with each mark, a struct that begins with line_no or null, carried forward in its file.

    Lines are dealt in runs of RUN line numbers of a file, and carried forward in each run; what holds before a
    run comes from one row per run, so that a file of any length is spread over tasks.
    """
    rows = lines.withColumn("__file", F.coalesce("file", F.lit(""))).withColumn("__run", F.shiftright("line_no", RUN.bit_length() - 1))
    last = rows.groupBy("__file", "__run").agg(*(F.max(m).alias(f"__last_{m}") for m in marks))
    runs = Window.partitionBy("__file").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("__file", "__run", *(F.max(f"__last_{m}").over(runs).alias(f"__before_{m}") for m in marks))
    within = Window.partitionBy("__file", "__run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Line numbers grow, so the last mark is the largest.
    held = rows.withColumns({f"__held_{m}": F.max(m).over(within) for m in marks}).join(before, ["__file", "__run"])
    return held.withColumns({m: F.coalesce(f"__held_{m}", f"__before_{m}") for m in marks}).drop("__file", "__run", *(f"__{k}_{m}" for k in ("held", "before") for m in marks))


def marked(lines: DataFrame) -> DataFrame:
    """The lines that aren't blank, with the title or the header that a line is."""
    first = F.element_at("cells", 1)
    rows = stripped_cells(lines).select("file", "line_no", "cells", F.when(first.rlike(TITLE), F.upper(F.regexp_extract(first, TITLE, 1))).alias("title"), F.coalesce(F.lower(first) == "campo", F.lit(False)).alias("is_header"))
    return rows.withColumn("named", F.when(F.col("title").isNotNull(), F.struct("line_no", "title"))).withColumn("headed", F.when(F.col("is_header"), F.struct("line_no", "cells")))


def placed(lines: DataFrame) -> DataFrame:
    """The lines with their table, table_line (of its title) and header, carried forward in each file."""
    rows = carried(marked(lines), ["named", "headed"])
    # The header counts from its table's title on.
    header = F.when(F.col("named").isNull() | (F.col("headed.line_no") > F.col("named.line_no")), F.col("headed.cells"))
    return rows.select("file", "line_no", "cells", "title", "is_header", F.col("named.title").alias("table"), F.col("named.line_no").alias("table_line"), header.alias("header"))


def reconciled(cells: Column, header: Column) -> Column:
    """The cells as many as the header: short rows are padded, the overflow is joined to the last by commas."""
    n, have = F.size(header), F.size(cells)
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(n - have, F.lit(0))))
    merged = F.concat(F.slice(cells, F.lit(1), n - 1), F.array(F.array_join(F.slice(cells, n, F.greatest(have - n + 1, F.lit(0))), ",")))
    return F.when(have > n, merged).otherwise(padded)


def cell(name: str) -> Column:
    """The value under the last header cell of this name, or null."""
    at = F.array_size("header") - F.array_position(F.reverse("header"), name) + 1
    return F.when(F.array_contains("header", name), F.element_at("values", at.cast("int")))


def with_fields(rows: DataFrame) -> DataFrame:
    values = rows.withColumn("values", reconciled(F.col("cells"), F.col("header")))
    names = {"field": "Campo", "kind": "Tipo", "length": "Longitud", "required": "Obligatorio", "description": "Descripción", "format": "Formato"}
    return values.select("file", "table", "line_no", *(cell(n).alias(a) for a, n in names.items()), F.col("values").alias("cells"))


def spec_fields(lines: DataFrame) -> DataFrame:
    """file, table, line_no, field, kind, length, required, description, format, cells of every field row."""
    rows = placed(lines).where(F.col("table").isNotNull() & F.col("header").isNotNull() & F.col("title").isNull() & ~F.col("is_header"))
    return with_fields(rows)


def single_table_fields(lines: DataFrame) -> DataFrame:
    """The same for files of one table each, named by the file: upper case, without `T_`."""
    held = carried(marked(lines), ["headed"]).withColumn("header", F.col("headed.cells"))
    rows = held.where(F.col("header").isNotNull() & ~F.col("is_header"))
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    return with_fields(rows.withColumn("table", F.upper(F.replace(stem, F.lit("T_"), F.lit("")))))


def kind_of(text: Column) -> Column:
    """The kind of a type name; names that aren't known stay."""
    known = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, trimmed(text)), trimmed(text))


def listed_values(description: Column) -> Column:
    """The values a description allows: a list in brackets, else SI and NO, else M and H."""
    inside = F.regexp_extract(description, r"Valores posibles: *\[([^\]]+)\]", 1)
    return (
        F.when(inside != "", F.transform(F.split(inside, ","), trimmed))
        .when(description.rlike(r"(?iU)\bSI/?NO\b"), F.array(F.lit("SI"), F.lit("NO")))
        .when(description.rlike("M= ?Mujer") & description.rlike("H= ?Hombre"), F.array(F.lit("M"), F.lit("H")))
    )


def enriched(fields: DataFrame) -> DataFrame:
    """The fields with kinds, allowed values, deprecation, and the foreign key with the text it was found in."""
    d = F.coalesce("description", F.lit(""))
    reference = F.regexp_extract(d, r"([A-Za-z0-9_]+)\.([A-Za-z0-9_]+)", 0)
    return fields.withColumns({"kind": kind_of(F.col("kind")), "enum": listed_values(d), "deprecated": F.contains(F.lower(d), F.lit("deprecado")), "foreign_key": F.when(reference != "", reference)})


def required_keys(fields: DataFrame) -> DataFrame:
    """(table, primary_key, fields): every required field is a key; both in line order."""
    row = F.struct("line_no", "field", F.lower(trimmed(F.col("required"))).isin("sí", "si").alias("key"))
    rows = fields.groupBy("table").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    named = lambda x: x["field"]
    return rows.select("table", F.transform(F.filter("rows", lambda x: x["key"]), named).alias("primary_key"), F.transform("rows", named).alias("fields"))


def noted(lines: DataFrame) -> DataFrame:
    """(file, table, line_no, note): the lines after a title that are neither header nor field."""
    rows = placed(lines).where(F.col("table").isNotNull() & F.col("title").isNull())
    text = F.regexp_replace(trimmed(F.array_join("cells", ",")), "^,+|,+$", "")
    parts = F.transform(F.split("note", ","), trimmed)
    low = F.lower("note")
    looks = (F.size(parts) >= 4) & F.forall(F.slice(parts, 1, 3), lambda p: p != "")
    marked = F.lit(False)
    for word in NOTE_WORDS:
        marked = marked | F.contains(low, F.lit(word))
    kept = (F.col("note") != "") & ~low.startswith("campo") & (F.element_at(parts, 1) != "") & ~(looks & ~marked)
    return rows.select("file", "table", "line_no", text.alias("note")).where(kept)


def after(text: Column, words: str) -> Column:
    """What follows the first occurrence of the words, or null."""
    at = F.locate(words, text)
    return F.when(at > 0, trimmed(F.substring(text, at + len(words), F.length(text))))


def split_trimmed(text: Column, by: str) -> Column:
    return F.transform(F.split(text, by), trimmed)


def note_keys(notes: DataFrame) -> DataFrame:
    """The notes with what they say of keys: expression, key_fields, operation; and unique_fields."""
    note, low = F.col("note"), F.lower("note")
    says = F.contains(low, F.lit("clave"))
    expression = F.when(says & F.contains(low, F.lit("compuesta por")), after(note, "compuesta por")).when(says & F.contains(low, F.lit("combinación de")), after(note, "combinación de"))
    expression = F.when(expression != "", expression)
    e = F.col("expression")
    listed = F.replace(F.replace(F.replace(F.regexp_extract(note, "^[^:]*:(.*)$", 1), F.lit(" y "), F.lit(",")), F.lit(" + "), F.lit(",")), F.lit("."), F.lit(""))
    head = F.split(note, "deben ser UNIQUE", 2)[0]
    unique = F.when(F.contains(note, F.lit(":")), split_trimmed(listed, ",")).otherwise(split_trimmed(head, ","))
    unique = F.filter(unique, lambda x: x != "")
    found = notes.withColumn("expression", expression)
    fields = F.when(F.contains(e, F.lit("+")), split_trimmed(e, r"\+")).when(F.contains(e, F.lit(",")), split_trimmed(e, ",")).when(F.contains(e, F.lit(" y ")), split_trimmed(e, " y ")).when(e.isNotNull(), F.array(e))
    found = found.withColumn("key_fields", fields).withColumn("operation", F.when(F.size("key_fields") > 1, "concat").when(e.isNotNull(), "field"))
    return found.withColumn("unique_fields", F.when(F.contains(low, F.lit("unique")) & (F.size(unique) > 0), unique))


def metadata(lines: DataFrame) -> DataFrame:
    """table, primary_key, operation, expression, unique_fields, notes; the last note that says so wins."""
    rows = note_keys(noted(lines)).groupBy("table").agg(
        F.max_by(F.struct("key_fields", "operation", "expression"), F.when(F.col("expression").isNotNull(), F.struct("file", "line_no"))).alias("key"),
        F.max_by("unique_fields", F.when(F.col("unique_fields").isNotNull(), F.struct("file", "line_no"))).alias("unique_fields"),
        F.array_sort(F.collect_list(F.struct("file", "line_no", "note"))).alias("notes"),
    )
    return rows.select("table", F.col("key.key_fields").alias("primary_key"), "key.operation", "key.expression", "unique_fields", F.transform("notes", lambda n: n["note"]).alias("notes"))


def from_text(docs: DataFrame, file_col: str, text_col: str, delimiter: str = ",") -> DataFrame:
    """lines() of texts whose cells hold no quoted delimiter."""
    rows = docs.select(F.col(file_col).cast("string").alias("file"), F.posexplode(F.split(text_col, r"\r?\n")).alias("line_no", "line"))
    return rows.select("file", (F.col("line_no") + 1).cast("long").alias("line_no"), F.split("line", delimiter).alias("cells"))
