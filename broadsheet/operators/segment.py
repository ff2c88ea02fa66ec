"""Segmentation of report texts into sections, items, tags, links, tables, fields and blocks.

A document arrives whole in one row, so daily reports and blocks are segmented inside that row: the array of
its lines is cut where a header, an item or a run opens, and only what is finished is exploded. No line is
shuffled, and the work is in proportion to the lines. A line is consumed by the first rule that fits. Of several
lines that give an attribute the last wins. Patterns take white space and digits of any script, and only a newline ends
a line.
"""

from __future__ import annotations

import os.path
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import cells_of, is_separator, iso_date, lines_of, normalize_newlines, strip, strip_anchor, strip_marks

#: Stands for "no section" in running windows, which skip nulls.
_RESET = "~"


@dataclass(frozen=True)
class DailyFormat:
    """Markers of daily reports (fixed values of the format)."""

    sections: tuple[tuple[str, str], ...] = (
        ("## 🇨🇳 国内要闻", "domestic"), ("## 🌍 国际要闻", "international"), ("## 📊 今日趋势总结", "trends"), ("## 📑 目录", "toc"),
    )
    resets: tuple[str, ...] = ("## ", "# ")
    item_sections: tuple[str, ...] = ("domestic", "international")
    table_sections: tuple[str, ...] = ("trends",)
    item: str = r"(?Ud)^### (\d+)\.\s*(.+)"
    tags: str = r"(?Ud)^🏷️\s*(.+)"
    tag_breaks: str = "[·,，、]"
    link: str = r"(?Ud)📎\s*\[(.+?)\]\((.+?)\)"
    image: str = r"(?Ud)^!\[.*?\]\((.+?)\)"
    note_label: str = r"(?U)\*\*点评[：:]\*\*\s*"
    footer: str = "*本日报由"


@dataclass(frozen=True)
class DigestFormat:
    """Markers of weekly and monthly digests (fixed values of the format)."""

    #: Header lines: what they begin with, what they hold, what they do not hold, and the section they open.
    headers: tuple[tuple[str, tuple[str, ...], str, str], ...] = (
        ("## 📊", ("概览",), "", "overview"), ("## 🔟", (), "", "items"), ("## 🔝", (), "", "items"), ("", ("要闻", "##"), "趋势", "items"),
        ("## 🗓️", (), "", "upcoming"), ("## 📅", (), "", "upcoming"), ("## 📊", ("趋势",), "", "trends"), ("## 📑", (), "", _RESET),
        ("## ", ("目录",), "", _RESET), ("## ", (), "", "rich"), ("# ", (), "", _RESET),
    )
    icon: str = "📄"
    #: Of a section of trends that is a free section.
    trends_icon: str = "📊"
    icon_mark: str = r"(?Ud)^##\s+(\S)\s"
    item: str = r"(?Ud)^### (\d+)\.\s*(.+)"
    link: str = r"(?Ud)📎\s*\[(.+?)\]\((.+?)\)"
    note_label: str = r"(?U)\*\*本[周月]新进展[：:]\*\*\s*"
    footer: tuple[str, ...] = ("*本周报由", "*本月报由")


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no from 0, line)."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def cut(rows: Column, opens: Callable[[Column, Column], Column]) -> Column:
    """array<array>: the elements of ``rows`` before the first that ``opens`` (element, position), possibly none;
    then from each that opens to before the next."""

    def groups(r: Column) -> Column:
        at = F.filter(F.transform(r, lambda x, i: F.when(opens(x, i), i)), lambda i: i.isNotNull())
        until = lambda bounds, k: F.coalesce(F.get(bounds, k + 1), F.size(r))
        return let(F.concat(F.array(F.lit(0)), at), lambda b: F.transform(b, lambda low, k: F.slice(r, low + 1, until(b, k) - low)))

    return let(rows, groups)


# Headers -------------------------------------------------------------------------------------------


def parse_header(docs: DataFrame, kind: str, key: str = "doc_id", text: str = "text", carry_year: bool = False) -> DataFrame:
    """doc_id, title and the dates of the first line: daily and jobs ``date`` (daily also ``weekday`` as written),
    weekly and monthly ``start_date``, ``ref_date`` and ``date_range``.

    A weekly range whose second year is missing takes the first year; ``carry_year`` moves it to the next year
    where it would otherwise end before it begins. A month's ref_date is its day 28.
    """
    return docs.select(F.col(key).alias("doc_id"), *header_columns(F.element_at(lines_of(F.col(text)), 1), kind, carry_year))


def header_columns(first: Column, kind: str, carry_year: bool = False) -> list[Column]:
    """The title and dates that :func:`parse_header` gives, from the first line."""
    part = lambda pattern, *groups: [F.regexp_extract(first, pattern, g) for g in groups]
    title = strip_marks(first).alias("title")
    if kind == "daily":
        pattern = r"(?Ud)^# .+?\|\s*(\d{4})年(\d{1,2})月(\d{1,2})日（(.+?)）"
        *ymd, weekday = part(pattern, 1, 2, 3, 4)
        columns = [iso_date(*ymd).alias("date"), F.nullif(weekday, F.lit("")).alias("weekday")]
    elif kind == "jobs":
        columns = [iso_date(*part(r"(?Ud)^# .+?\|\s*(\d{4})[年-](\d{1,2})[月-](\d{1,2})", 1, 2, 3)).alias("date")]
    elif kind == "weekly":
        pattern = r"(?Ud)^# .+?\|\s*(\d{4})年(\d{1,2})月(\d{1,2})日\s*[—\-]\s*(?:(\d{4})年)?(\d{1,2})月(\d{1,2})日"
        y1, m1, d1, y2, m2, d2 = part(pattern, 1, 2, 3, 4, 5, 6)
        start, end = iso_date(y1, m1, d1), iso_date(F.coalesce(F.nullif(y2, F.lit("")), y1), m2, d2)
        if carry_year:
            end = F.when((y2 == "") & (end < start), F.add_months(end, 12)).otherwise(end)
        columns = [start.alias("start_date"), end.alias("ref_date"), F.concat(start.cast("string"), F.lit(" — "), end.cast("string")).alias("date_range")]
    elif kind == "monthly":
        y, m = part(r"(?Ud)^# .+?\|\s*(\d{4})年(\d{1,2})月", 1, 2)
        start = iso_date(y, m, F.lit("1"))
        named = F.when(y != "", F.concat(y, F.lit("年"), m.cast("int"), F.lit("月")))
        columns = [start.alias("start_date"), F.date_add(start, 27).alias("ref_date"), named.alias("date_range")]
    else:
        raise ValueError(kind)
    return [title, *columns]


# Sections, items and line types of daily reports ----------------------------------------------------


def _numbered(docs: DataFrame, key: str, rows: Column, number: str, row: str) -> DataFrame:
    """(doc_id, number from 0, row) of the elements of ``rows``. The outer form, whose nulls go afterwards, keeps the
    optimizer from testing the array's size first, which would compute it again."""
    found = docs.select(F.col(key).alias("doc_id"), F.posexplode_outer(rows).alias(number, row))
    return found.filter(F.col(number).isNotNull())


def _sectioned(lines: Column, sections: tuple[tuple[str, str], ...], resets: tuple[str, ...]) -> Column:
    """array<struct<line, header, section>> of an array of lines; see :func:`assign_sections`."""
    common = os.path.commonprefix([*resets, *(prefix for prefix, _ in sections)])

    def header(line: Column) -> Column:
        opened = F.lit(None).cast("string")
        for prefix in reversed(resets):
            opened = F.when(line.startswith(prefix), F.lit(_RESET)).otherwise(opened)
        for prefix, name in reversed(sections):
            opened = F.when(line.startswith(prefix), F.lit(name)).otherwise(opened)
        return F.when(line.startswith(common), opened)  # most lines need one comparison

    return F.flatten(_parts(lines, header))


def _parts(lines: Column, header: Callable[[Column], Column]) -> Column:
    """array<array<struct<line, header, section>>>: ``lines`` before the first that is a ``header``, and from each on."""

    def placed(part: Column) -> Column:
        section = F.nullif(F.get(part, 0)["header"], F.lit(_RESET))
        row = lambda r, of: F.struct(r["line"].alias("line"), r["header"].alias("header"), of.alias("section"))
        return let(section, lambda of: F.transform(part, lambda r: row(r, of)))

    headed = F.transform(lines, lambda line: F.struct(line.alias("line"), header(line).alias("header")))
    return F.transform(cut(headed, lambda r, _: r["header"].isNotNull()), placed)


def assign_sections(
    docs: DataFrame, sections: tuple[tuple[str, str], ...], resets: tuple[str, ...] = ("## ", "# "), key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, line_no from 0, line, header: the section a header line opens, ``~`` for none, section: the one it stands in)."""
    rows = _sectioned(lines_of(F.col(text)), sections, resets)
    return _numbered(docs, key, rows, "line_no", "_row").select("doc_id", "line_no", "_row.*")


def _daily_groups(text: Column, fmt: DailyFormat) -> Column:
    """array<array<struct<line, header, section, is_item>>>: the lines after the title, before the first item and of
    each item. A section header does not close an item."""

    def marked(r: Column) -> Column:
        opens = r["header"].isNull() & r["section"].isin(*fmt.item_sections) & r["line"].rlike(fmt.item)
        return F.struct(*[r[n].alias(n) for n in ("line", "header", "section")], F.coalesce(opens, F.lit(False)).alias("is_item"))

    lines = let(lines_of(text), lambda x: F.slice(x, F.lit(2), F.size(x)))
    rows = F.transform(_sectioned(lines, fmt.sections, fmt.resets), marked)
    return cut(rows, lambda r, _: r["is_item"])


def _daily_kind(line: Column, header: Column, section: Column, is_item: Column, in_item: Column, fmt: DailyFormat) -> Column:
    return (
        F.when(header == _RESET, "reset")
        .when(header.isNotNull(), "section")
        .when(is_item, "item")
        .when(in_item & line.rlike(fmt.tags), "tags")
        .when(in_item & line.rlike(fmt.link), "links")
        .when(in_item & line.rlike(fmt.image), "image")
        .when(in_item & line.startswith("> "), "note")
        .when(section.isin(*fmt.table_sections) & line.startswith("|"), "table")
        .when(strip(line).startswith(fmt.footer), "footer")
        .when(in_item & (strip(line) != "") & ~line.startswith("---") & ~line.startswith(">"), "body")
        .otherwise("other")
    )


def daily_lines(docs: DataFrame, fmt: DailyFormat = DailyFormat(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The lines of daily reports after their title (line_no from 1), each with section, is_item, item_no (items
    opened so far) and line_type, the rule that consumes it."""
    fields = ("line", "header", "section", "is_item")
    numbered = lambda group, k: F.transform(group, lambda r: F.struct(*[r[n].alias(n) for n in fields], k.alias("item_no")))
    rows = F.flatten(F.transform(_daily_groups(F.col(text), fmt), numbered))
    found = _numbered(docs, key, rows, "_at", "_row").select("doc_id", (F.col("_at") + 1).alias("line_no"), "_row.*")
    return found.withColumn("line_type", _daily_kind(*map(F.col, fields), F.col("item_no") > 0, fmt))


def extract_tags(line: Column, fmt: DailyFormat = DailyFormat()) -> Column:
    parts = F.transform(F.split(F.regexp_extract(line, fmt.tags, 1), fmt.tag_breaks), strip)
    return F.filter(parts, lambda t: t != "")


def extract_links(line: Column, link: str = DailyFormat.link) -> Column:
    """array<struct<name, url>> of the marked links of a line."""
    names, urls = (F.regexp_extract_all(line, F.lit(link), F.lit(g)) for g in (1, 2))
    return F.zip_with(names, urls, lambda n, u: F.struct(n.alias("name"), u.alias("url")))


def extract_image(line: Column, image: str = DailyFormat.image) -> Column:
    return F.regexp_extract(line, image, 1)


def extract_note(line: Column, label: str = DailyFormat.note_label) -> Column:
    """A quoted line without its quote marks and label."""
    return strip(F.regexp_replace(strip_marks(line, "> "), label, ""))


#: What stands in every line that one of the format's own patterns finds; a test of it is much cheaper than the pattern.
_LITERALS = {DailyFormat.item: "### ", DailyFormat.tags: "🏷️", DailyFormat.link: "📎", DailyFormat.image: "!["}


def _finds(line: Column, pattern: str) -> Column:
    return line.contains(_LITERALS[pattern]) & line.rlike(pattern) if pattern in _LITERALS else line.rlike(pattern)


def _daily_pieces(text: Column, fmt: DailyFormat) -> Column:
    """array<array<struct<section, piece, bare, is_item>>>: the text from the first section header on in pieces of whole
    lines, before the first item and of each item.

    The text is split at headers, and what may hold items at lines that may open one, so single lines are not made
    here. ``bare`` pieces begin with a line that is neither a header nor an item.
    """
    heads = sorted({*fmt.resets, *(prefix for prefix, _ in fmt.sections)})
    literal = lambda s: "\\Q" + s + "\\E"
    at_header = "\n(?=" + "|".join(map(literal, heads)) + ")"
    at_item = "\n(?=" + literal(_LITERALS[fmt.item]) + ")" if fmt.item in _LITERALS else "\n"  # else each line may be one

    def section_of(part: Column) -> Column:
        opened = F.lit(None).cast("string")
        for prefix in reversed(fmt.resets):
            opened = F.when(part.startswith(prefix), F.lit(None).cast("string")).otherwise(opened)
        for prefix, name in reversed(fmt.sections):
            opened = F.when(part.startswith(prefix), F.lit(name)).otherwise(opened)
        return opened

    def of_part(part: Column, section: Column) -> Column:
        def row(piece: Column, i: Column) -> Column:
            is_item = (i > 0) & _finds(F.substring_index(piece, "\n", 1), fmt.item)
            return F.struct(section.alias("section"), piece.alias("piece"), ((i > 0) & ~is_item).alias("bare"), is_item.alias("is_item"))

        pieces = F.when(section.isin(*fmt.item_sections), F.split(part, at_item, -1)).otherwise(F.array(part))
        return F.transform(pieces, row)

    plain = let(text, lambda t: F.when(t.contains("\r"), normalize_newlines(t)).otherwise(t))  # the text may be an expression
    after_title = let(plain, lambda t: F.when(F.instr(t, "\n") > 0, F.substring(t, F.instr(t, "\n"), F.length(t))))
    parts = let(F.split(after_title, at_header, -1), lambda p: F.slice(p, F.lit(2), F.size(p)))
    return cut(F.flatten(F.transform(parts, lambda part: let(section_of(part), lambda of: of_part(part, of)))), lambda r, _: r["is_item"])


def _item_kind(line: Column, section: Column, fmt: DailyFormat) -> Column:
    """:func:`_daily_kind` of a line of an item that is neither a header nor opens an item."""
    filled = line.rlike(r"(?U)\S")
    return (
        F.when(_finds(line, fmt.tags), "tags").when(_finds(line, fmt.link), "links").when(_finds(line, fmt.image), "image")
        .when(line.startswith("> "), "note")
        .when(section.isin(*fmt.table_sections) & line.startswith("|"), "table")
        .when(line.contains(fmt.footer) & strip(line).startswith(fmt.footer), "footer")
        .when(filled & ~line.startswith("---") & ~line.startswith(">"), "body")
        .otherwise("other")
    )


def daily_items(docs: DataFrame, fmt: DailyFormat = DailyFormat(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per item of daily reports: item_no in order of the text, the section it opens in, and its attributes."""
    groups = _numbered(docs, key, _daily_pieces(F.col(text), fmt), "item_no", "_pieces").filter("item_no > 0")

    def typed(piece: Column) -> Column:
        lines = let(F.split(piece["piece"], "\n", -1), lambda x: F.when(piece["bare"], x).otherwise(F.slice(x, F.lit(2), F.size(x))))
        return F.transform(lines, lambda line: F.struct(line.alias("line"), _item_kind(line, piece["section"], fmt).alias("kind")))

    opening = F.get("_pieces", 0)
    first = F.substring_index(opening["piece"], "\n", 1)
    groups = groups.select("doc_id", "item_no", opening["section"].alias("section"), first.alias("_first"), F.flatten(F.transform("_pieces", typed)).alias("_typed"))
    of_kind = lambda kind: F.transform(F.filter("_typed", lambda r: r["kind"] == kind), lambda r: r["line"])
    last = lambda kind: F.try_element_at(of_kind(kind), F.lit(-1))
    return groups.select(
        "doc_id", "item_no", "section", F.concat(F.lit("item"), F.col("item_no")).alias("item_id"),
        strip_anchor(strip(F.regexp_extract("_first", fmt.item, 2))).alias("title"),
        extract_tags(last("tags"), fmt).alias("tags"), extract_links(last("links"), fmt.link).alias("sources"),
        extract_image(last("image"), fmt.image).alias("image"), F.array_join(of_kind("body"), "\n").alias("body"),
        extract_note(last("note"), fmt.note_label).alias("commentary"),
    )


def table_rows(typed: DataFrame, *sections: str) -> DataFrame:
    """(doc_id, section, row_no from 0, cells) of the pipe tables of some sections, without separator rows."""
    rows = typed.filter((F.col("line_type") == "table") & F.col("section").isin(*sections)).withColumn("cells", cells_of("line"))
    kept = rows.filter(~is_separator("cells") & (F.size("cells") > 0))
    order = Window.partitionBy("doc_id", "section").orderBy("line_no")
    return kept.select("doc_id", "section", (F.row_number().over(order) - 1).alias("row_no"), "cells")


def report_counts(items: DataFrame) -> DataFrame:
    """Domestic, international and all items of each report."""
    return items.groupBy("doc_id").agg(
        F.count_if(F.col("section") == "domestic").alias("domestic_count"),
        F.count_if(F.col("section") == "international").alias("international_count"),
        F.count(F.lit(1)).alias("total_count"),
    )


# Digests --------------------------------------------------------------------------------------------


def _digest_header(line: Column, fmt: DigestFormat, strict: bool) -> Column:
    """The section that a header line opens, ``~`` for none; null for other lines."""
    header = F.lit(None).cast("string")
    for prefix, holds, lacks, section in reversed(fmt.headers):
        test = line.startswith("## " if strict and not prefix else prefix)
        for word in holds:
            test = test & line.contains(word)
        if lacks:
            test = test & ~line.contains(lacks)
        header = F.when(test, F.lit(section)).otherwise(header)
    return F.when(line.contains("#"), header)  # most lines need one test


def _digest_parts(text: Column, kind: str, fmt: DigestFormat, strict: bool) -> Column:
    """The lines after the title as :func:`_parts`; trends are a free section except in weekly digests."""

    def header(line: Column) -> Column:
        found = lambda h: h if kind == "weekly" else F.when(h == "trends", F.lit("rich")).otherwise(h)
        return let(_digest_header(line, fmt, strict), found)

    return _parts(let(lines_of(text), lambda x: F.slice(x, F.lit(2), F.size(x))), header)


def _digest_groups(text: Column, kind: str, fmt: DigestFormat, strict: bool) -> Column:
    """array<array<struct<line, header, section, is_item, is_ranked>>>: cut at every header, item and ranked row, all
    of which close the open item."""

    def ranked(line: Column) -> Column:
        if kind != "monthly":
            return F.lit(False)
        cells = lambda c: (F.size(c) >= 3) & F.get(c, 0).rlike(r"(?U)^\d+$")
        return line.startswith("|") & let(cells_of(line), cells)

    def marked(r: Column) -> Column:
        inside = r["header"].isNull() & (r["section"] == "items")
        is_item = F.coalesce(inside & r["line"].rlike(fmt.item), F.lit(False))
        is_ranked = F.coalesce(inside & ranked(r["line"]), F.lit(False))
        return F.struct(*[r[n].alias(n) for n in ("line", "header", "section")], is_item.alias("is_item"), is_ranked.alias("is_ranked"))

    rows = F.transform(F.flatten(_digest_parts(text, kind, fmt, strict)), marked)
    return cut(rows, lambda r, _: r["header"].isNotNull() | r["is_item"] | r["is_ranked"])


def _digest_kind(r: Column, in_item: Column, fmt: DigestFormat) -> Column:
    """The rule that consumes a line."""
    line = r["line"]
    footer = lambda bare: bare.startswith(fmt.footer[0]) | bare.startswith(fmt.footer[1])
    return (
        F.when(r["header"] == _RESET, "reset").when(r["header"].isNotNull(), "section")
        .when(F.coalesce(r["section"] == "rich", F.lit(False)), "rich")
        .when(r["is_item"], "item")
        .when(in_item & line.rlike(fmt.link), "links")
        .when(in_item & line.startswith("> "), "note")
        .when(line.startswith("|"), "table")
        .when(footer(strip(line)), "footer")
        .when((r["section"] == "overview") & (strip(line) != "") & ~line.startswith("---"), "overview")
        .when(in_item & (strip(line) != "") & ~line.startswith("---") & ~line.startswith(">"), "body")
        .otherwise("other")
    )


def _digest_rows(text: Column, kind: str, fmt: DigestFormat, strict: bool) -> Column:
    """array<array<struct<line, header, section, is_item, is_ranked, in_item, line_type>>> of :func:`_digest_groups`."""
    fields = ("line", "header", "section", "is_item", "is_ranked")

    def typed(group: Column) -> Column:
        row = lambda r, inside: F.struct(
            *[r[n].alias(n) for n in fields], inside.alias("in_item"), _digest_kind(r, inside, fmt).alias("line_type"))
        opened = lambda first: first["is_item"] | first["is_ranked"]
        return let(F.coalesce(opened(F.get(group, 0)), F.lit(False)), lambda inside: F.transform(group, lambda r: row(r, inside)))

    return F.transform(_digest_groups(text, kind, fmt, strict), typed)


def digest_lines(docs: DataFrame, kind: str, fmt: DigestFormat = DigestFormat(), strict: bool = False, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """The lines of weekly or monthly digests after their title (line_no from 1), with section, item and line type.

    Every header closes the open item. A line that names the headlines and holds ``##`` opens the items section
    at any level; ``strict`` asks for a level-two header. Sections and items are cut within the row; no line is shuffled.
    """
    found = _numbered(docs, key, F.flatten(_digest_rows(F.col(text), kind, fmt, strict)), "_at", "_row")
    return found.select("doc_id", (F.col("_at") + 1).alias("line_no"), "_row.*")


def ranking_rows_to_items(typed: DataFrame) -> DataFrame:
    """(doc_id, item_id, title, body) of the ranked rows of a monthly table: rank, title, date, reason."""
    cells = cells_of("line")
    rest = F.coalesce(F.get("cells", 3), F.lit(""))
    body = F.when(rest != "", F.concat(F.lit("📅 "), F.get("cells", 2), F.lit(" ｜ "), rest)).otherwise(F.get("cells", 2))
    ranked = typed.filter("is_ranked").withColumn("cells", cells)
    return ranked.select("doc_id", F.concat(F.lit("item"), F.get("cells", 0)).alias("item_id"), F.get("cells", 1).alias("title"), body.alias("body"))


def digest_items(docs: DataFrame, kind: str, fmt: DigestFormat = DigestFormat(), strict: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id by declared number, title, sources, body, progress) of the ``### N.`` items."""
    groups = F.filter(_digest_rows(F.col(text), kind, fmt, strict), lambda g: F.coalesce(F.get(g, 0)["is_item"], F.lit(False)))
    items = _numbered(docs, key, groups, "_at", "_rows")
    of_kind = lambda name: F.transform(F.filter("_rows", lambda r: r["line_type"] == name), lambda r: r["line"])
    last = lambda name: F.try_element_at(of_kind(name), F.lit(-1))
    opening = F.get("_rows", 0)["line"]
    return items.select(
        "doc_id", F.concat(F.lit("item"), F.regexp_extract(opening, fmt.item, 1)).alias("item_id"),
        strip_anchor(strip(F.regexp_extract(opening, fmt.item, 2))).alias("title"), extract_links(last("links"), fmt.link).alias("sources"),
        F.array_join(F.transform(of_kind("body"), strip), "\n").alias("body"), extract_note(last("note"), fmt.note_label).alias("progress"),
    )


def rich_sections(docs: DataFrame, kind: str, fmt: DigestFormat = DigestFormat(), strict: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section_no from 1, icon, heading, lines) of the free sections; an icon is one code point before white
    space, and fixed where trends are a free section."""
    rich = F.filter(_digest_parts(F.col(text), kind, fmt, strict), lambda part: F.coalesce(F.get(part, 0)["header"] == "rich", F.lit(False)))
    found = _numbered(docs, key, rich, "_at", "_part")
    opening = F.get("_part", 0)["line"]
    own = F.coalesce(F.nullif(F.regexp_extract(opening, fmt.icon_mark, 1), F.lit("")), F.lit(fmt.icon))
    icon = F.when(_digest_header(opening, fmt, strict) == "trends", F.lit(fmt.trends_icon)).otherwise(own)
    lines = F.transform(F.slice("_part", F.lit(2), F.size("_part")), lambda r: r["line"])
    heading = strip_anchor(strip(strip_marks(opening)))
    return found.select("doc_id", (F.col("_at") + 1).alias("section_no"), icon.alias("icon"), heading.alias("heading"), lines.alias("lines"))


def overview_and_footer(docs: DataFrame, kind: str, fmt: DigestFormat = DigestFormat(), strict: bool = False, key: str = "doc_id",
                        text: str = "text") -> DataFrame:
    """(doc_id, overview: its lines joined by a space, footer: the last footer line without its stars)."""
    typed = docs.select(F.col(key).alias("doc_id"), F.flatten(_digest_rows(F.col(text), kind, fmt, strict)).alias("_rows"))
    of_kind = lambda name: F.transform(F.filter("_rows", lambda r: r["line_type"] == name), lambda r: strip(r["line"]))
    footer = F.regexp_replace(F.try_element_at(of_kind("footer"), F.lit(-1)), r"^\*+|\*+$", "")
    return typed.select("doc_id", F.coalesce(F.array_join(of_kind("overview"), " "), F.lit("")).alias("overview"), footer.alias("footer"))


def digest_counts(docs: DataFrame, kind: str, fmt: DigestFormat = DigestFormat(), strict: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, items, rich): the items and ranked rows, and the free sections, of each digest."""
    groups, parts = _digest_groups(F.col(text), kind, fmt, strict), _digest_parts(F.col(text), kind, fmt, strict)
    count = lambda rows, test: F.coalesce(F.size(F.filter(rows, lambda g: F.coalesce(test(F.get(g, 0)), F.lit(False)))), F.lit(0))
    items, rich = count(groups, lambda r: r["is_item"] | r["is_ranked"]), count(parts, lambda r: r["header"] == "rich")
    return docs.select(F.col(key).alias("doc_id"), items.cast("long").alias("items"), rich.cast("long").alias("rich"))


def segment_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, block_no from 1, block_type, items) of whole texts: headings and quotes line by line, runs of table
    rows, bullets, numbered lines, and paragraphs (one item, their lines joined by a space)."""

    def kind(line: Column) -> Column:
        return (
            F.when(strip(line).isin("", "---"), "blank")
            .when(line.rlike(r"(?Ud)^###\s+.+"), "heading").when(line.startswith("|"), "table").when(line.startswith("> "), "quote")
            .when(line.rlike(r"(?U)^-\s+"), "bullets").when(line.rlike(r"(?U)^\d+\.\s+"), "numbered")
            .when(line.rlike(r"^[#>-]"), "skip").otherwise("paragraph")
        )

    def runs(typed: Column) -> Column:
        opens = lambda r, at: r["kind"].isin("heading", "quote") | (r["kind"] != F.get(typed, at - 1)["kind"])
        return F.filter(cut(typed, opens), lambda run: ~F.coalesce(F.get(run, 0)["kind"].isin("blank", "skip"), F.lit(True)))

    typed = F.transform(lines_of(F.col(text)), lambda line: F.struct(line.alias("line"), kind(line).alias("kind")))
    found = _numbered(docs, key, let(typed, runs), "_at", "_run")
    block = F.get("_run", 0)["kind"]
    bare = {
        "heading": lambda line: strip_anchor(strip(F.regexp_replace(line, r"(?U)^###\s+", ""))), "quote": extract_note,
        "bullets": lambda line: F.regexp_replace(line, r"(?U)^-\s+", ""), "numbered": lambda line: F.regexp_replace(line, r"(?U)^\d+\.\s+", ""),
    }
    lines = F.transform("_run", lambda r: r["line"])
    items = F.when(block == "paragraph", F.array(F.array_join(F.transform(lines, strip), " ")))
    for name, rule in bare.items():
        items = items.when(block == name, F.transform(lines, rule))
    return found.select("doc_id", (F.col("_at") + 1).alias("block_no"), block.alias("block_type"), items.otherwise(lines).alias("items"))
