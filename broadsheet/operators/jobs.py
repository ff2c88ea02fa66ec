"""Job listings: segmentation, deadlines, urgency, order and roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import ascii_digits, first_line, lines_of, strip
from broadsheet.operators.segment import cut, header_columns, let

#: Patterns of job lists (fixed values of the format).
CATEGORY = r"(?Ud)^##\s+(.{1,2})\s+(.+)"
ITEM = r"(?Ud)^###\s+(\d+)\.\s+(⏰\s*)?(.+?)\s*[—\-]\s*(.+)"
FIELD = r"(?Ud)^-\s*.+?\*\*(.+?)\*\*\s*[：:]\s*(.+)"
LINK = r"(?Ud)^-\s*🔗\s*\[(.+?)\]\((.+?)\)"
EMAIL = r"(?Ud)^-\s*📧\s*(?:投递[：:]\s*)?([a-zA-Z0-9._%+-]+@[^\s|]+)"
#: What stands where a list says nothing (fixed values of the format).
CATEGORY_DEFAULT, ICON_DEFAULT, LINK_TEXT_DEFAULT, VALUE_DEFAULT = "招聘", "💼", "招聘公告", "详见公告"
LABELS = (("学历", "education"), ("地点", "location"), ("截止", "deadline"), ("待遇", "note"))


def _typed_lines(text: Column) -> Column:
    """array<struct<line_no, line, kind>> of the trimmed lines after the title; fields and contacts are still ``other``."""

    def kind(line: Column) -> Column:
        header = F.when(line.rlike(CATEGORY), "category").when(line.rlike(ITEM), "item")
        kinds = F.when((line == "") | line.startswith("---"), "blank").when(line.startswith("> "), "summary").when(line.startswith("##"), header)
        return F.coalesce(kinds, F.lit("other"))

    row = lambda line, i: let(strip(line), lambda bare: F.struct(i.alias("line_no"), bare.alias("line"), kind(bare).alias("kind")))
    return let(F.transform(lines_of(text), row), lambda rows: F.slice(rows, F.lit(2), F.size(rows)))


def _listings(text: Column) -> Column:
    """array<struct<section_no, header, rows>>: every listing with the category header it stands under (null: none) and its
    lines. Lists are cut into categories, these into listings; a category closes the open listing."""

    def of_section(section: Column, number: Column) -> Column:
        header = F.when(number > 0, F.get(section, 0)["line"])
        items = lambda groups: F.slice(groups, F.lit(2), F.size(groups))
        item = lambda rows: F.struct(number.alias("section_no"), header.alias("header"), rows.alias("rows"))
        return F.transform(let(cut(section, lambda r, _: r["kind"] == "item"), items), item)

    return F.flatten(F.transform(cut(_typed_lines(text), lambda r, _: r["kind"] == "category"), of_section))


def extract_fields(rows: Column, labels=LABELS) -> dict[str, Column]:
    """The value of the last field line whose label holds a word; the first word that fits routes a label."""

    def field(r: Column) -> Column:
        label, route = strip(F.regexp_extract(r["line"], FIELD, 1)), F.lit(None).cast("string")
        for word, name in reversed(labels):
            route = F.when(label.contains(word), F.lit(name)).otherwise(route)
        return F.struct(route.alias("name"), strip(F.regexp_extract(r["line"], FIELD, 2)).alias("value"))

    fields = F.transform(F.filter(rows, lambda r: r["line"].rlike(FIELD)), field)
    last = lambda name: lambda found: F.try_element_at(F.filter(found, lambda f: f["name"] == name), F.lit(-1))["value"]
    return {name: let(fields, last(name)) for _, name in labels}


def extract_contact(rows: Column) -> dict[str, Column]:
    """link_url and link_text: of the last link or e-mail line that is no field."""

    def contact(r: Column) -> Column:
        line = r["line"]
        link = F.struct(F.regexp_extract(line, LINK, 2).alias("url"), F.regexp_extract(line, LINK, 1).alias("text"))
        email = let(F.regexp_extract(line, EMAIL, 1), lambda e: F.struct(F.concat(F.lit("mailto:"), e).alias("url"), e.alias("text")))
        return F.when(line.rlike(FIELD), F.lit(None)).when(line.rlike(LINK), link).when(line.rlike(EMAIL), email)

    found = F.filter(F.transform(F.filter(rows, lambda r: r["line"].startswith("-")), contact), lambda c: c.isNotNull())
    last = F.try_element_at(found, F.lit(-1))
    return {"link_url": last["url"], "link_text": F.coalesce(last["text"], F.lit(LINK_TEXT_DEFAULT))}


def parse_jobs(docs: DataFrame, default_category: str = CATEGORY_DEFAULT, default_icon: str = ICON_DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per listing, with update_date, deadline_date, days_left and urgent. Lists are cut within their row: no line
    is shuffled."""
    # The date is taken once a list, before its listings part: behind the explode each listing would cut the list again.
    dated = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), let(first_line(F.col(text)), lambda f: header_columns(f, "jobs")[1]).alias("update_date"))
    found = dated.select("doc_id", "update_date", F.explode_outer(_listings(F.col("_text"))).alias("_item"))
    found = found.filter(F.col("_item").isNotNull()).select("doc_id", "update_date", "_item.*")
    opening, header = F.get("rows", 0)["line"], F.col("header")
    value = lambda group: F.regexp_extract(opening, ITEM, group)
    columns = {
        "line_no": F.get("rows", 0)["line_no"], "section_no": F.col("section_no"),
        "category": F.coalesce(F.regexp_extract(header, CATEGORY, 2), F.lit(default_category)),
        "icon": F.coalesce(F.regexp_extract(header, CATEGORY, 1), F.lit(default_icon)),
        "number": ascii_digits(value(1)).cast("int"), "marked": value(2) != "", "institution": strip(value(3)), "position": strip(value(4)),
        **extract_fields(F.col("rows")), **extract_contact(F.col("rows")),
    }
    return with_urgency(found.select("doc_id", *[c.alias(n) for n, c in columns.items()], "update_date"))


def job_summary_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, summary): the quoted lines without their mark, joined by a space."""
    quoted = F.filter(_typed_lines(F.col(text)), lambda r: r["kind"] == "summary")
    joined = F.array_join(F.transform(quoted, lambda r: strip(F.substring(r["line"], F.lit(3), F.length(r["line"])))), " ")
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(joined, F.lit("")).alias("summary"))


def deadline_date(deadline) -> Column:
    """The ISO date a free text begins with; null if there is none or it names no day."""
    return F.try_to_date(F.nullif(F.regexp_extract(deadline, r"(?U)^(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("")), "y-M-d")


def days_left(deadline, update) -> Column:
    return F.datediff(deadline, update)


def urgent(marked, left, within: int = 3) -> Column:
    """Marked, or due in 0 to ``within`` days."""
    return marked | F.coalesce((left >= 0) & (left <= within), F.lit(False))


def closing_badge(is_urgent, deadline) -> Column:
    return F.when(is_urgent & deadline.isNotNull(), F.format_string("%d月%d日截止", F.month(deadline), F.dayofmonth(deadline)))


def fill_default(column, default: str = VALUE_DEFAULT) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


def with_urgency(jobs: DataFrame) -> DataFrame:
    """``jobs`` (deadline, update_date, marked) with deadline_date, days_left and urgent."""
    dated = jobs.withColumn("deadline_date", deadline_date(F.col("deadline")))
    counted = dated.withColumn("days_left", days_left(F.col("deadline_date"), F.col("update_date")))
    return counted.withColumn("urgent", urgent(F.col("marked"), F.col("days_left")))


def sort_jobs(jobs: DataFrame, *within: str) -> DataFrame:
    """Within sections by days left, expired first and undated last, ties as they stand in the text; with the
    place (from 1) in the document."""
    order = [*within, F.col("days_left").asc_nulls_last(), "line_no"]
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return jobs.withColumn("place", place).orderBy("doc_id", *order)


def job_summary(jobs: DataFrame) -> DataFrame:
    """Listings and urgent ones per category, in section order."""
    return jobs.groupBy("category").agg(
        F.min("section_no").alias("section_no"), F.count(F.lit(1)).alias("jobs"), F.count_if("urgent").alias("urgent_jobs")
    )
