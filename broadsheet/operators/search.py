"""Keyword search with snippets, for one query or a table of queries."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.sources.documents import write_by_date
from broadsheet.sources.shared import written


def query_terms(query) -> Column:
    """array<string>: lower-cased words; empty for an empty query, which stands for everything."""
    return F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda t: t != "")


def search_text(*columns) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def matches(text, terms) -> Column:
    """Any term stands in ``text``, or there are no terms."""
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(text, t))


def search(items: DataFrame, query: str, *columns: str) -> DataFrame:
    """The items in whose ``columns`` a term of ``query`` stands."""
    return items.filter(matches(search_text(*columns), query_terms(F.lit(query))))


def first_term(text, terms) -> Column:
    """The first term, in query order, that stands in ``text``."""
    return F.get(F.filter(terms, lambda t: F.contains(text, t)), F.lit(0))


def snippet(text, term, before: int = 30, after: int = 40) -> Column:
    """The surroundings of the first match, in code points, with an ellipsis on cut sides."""
    at = F.instr(F.lower(text), term) - 1
    low = F.greatest(at - before, F.lit(0))
    high = F.least(at + F.length(term) + after, F.length(text))
    body = F.substring(text, low + 1, high - low)
    cut = F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(high < F.length(text), "…").otherwise(""))
    return F.when(at >= 0, cut)


def highlight(text, term: str, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Every occurrence of ``term`` in any case between ``opening`` and ``closing``."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    guard = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, f"(?iu){quoted}", guard(opening) + "$0" + guard(closing))


def first_match(items: DataFrame, report: Sequence[str], order: str) -> DataFrame:
    """The first item of each report in text order."""
    return items.groupBy(*report).agg(F.min_by(F.struct("*"), order).alias("_first")).select("_first.*")


def search_hits(items: DataFrame, query: str, report: Sequence[str], *columns: str) -> DataFrame:
    """One row: how many reports hold a match."""
    return search(items, query, *columns).agg(F.count_distinct(*report).alias("hits"))


def words_with_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, term) for every distinct ``word`` that holds a ``term``, by an equality join.

    A word is cut into its pieces of the lengths that terms have (a handful), so the work grows with the
    vocabulary, not with words times terms.
    """
    sizes = terms.agg(F.collect_set(F.length("term")).alias("_sizes"))  # no more values than the longest term has characters
    sized = words.select("word").distinct().crossJoin(F.broadcast(sizes))
    fits = sized.select("word", F.explode("_sizes").alias("_size")).filter(F.length("word") >= F.col("_size"))
    places = F.explode(F.sequence(F.lit(1), F.length("word") - F.col("_size") + 1))
    pieces = fits.select("word", "_size", places.alias("_at")).select("word", F.substring("word", F.col("_at"), F.col("_size")).alias("term"))
    return pieces.join(terms.select("term").distinct(), "term").distinct()


def search_batch(items: DataFrame, queries: DataFrame, query_id: str, report: Sequence[str], order: str, text: str, *columns: str) -> DataFrame:
    """For a table of queries (query_id, terms) the first matching item of each report, with a snippet of ``text``.

    A term holds no white space, so it stands in one word of an item. The first item of each report with a word is
    found before anything is joined (partial sums before the shuffle), then the first with a term, then the first of
    the query; texts are joined back to the results alone. ``order`` is unique in a report. A query without terms
    finds nothing here.
    """
    asked = queries.select(query_id, F.posexplode("terms").alias("term_no", "term"))
    word = F.explode(F.array_distinct(query_terms(search_text(*columns)))).alias("word")
    first_word = items.select(*report, order, word).groupBy(*report, "word").agg(F.min(order).alias(order))
    found = first_word.join(words_with_terms(first_word, asked), "word").groupBy(*report, "term").agg(F.min(order).alias(order))
    return _first_hits(found, asked, items, query_id, report, order, text)


def _first_hits(first_term: DataFrame, asked: DataFrame, items: DataFrame, query_id: str, report: Sequence[str], order: str, text: str) -> DataFrame:
    """The first item of each report for each query, with a snippet, from the first item of each (report, term).

    The results are written before they meet the texts: Spark then knows their size, and shuffles texts only if it is large.
    """
    best = first_term.join(asked, "term").groupBy(query_id, *report).agg(F.min(F.struct(order, "term_no", "term")).alias("_best"))
    first = written(best.select(query_id, *report, f"_best.{order}", "_best.term"), "first_hits")
    found = first.join(items.select(*report, order, text), [*report, order])
    return found.select(query_id, *report, order, "term", snippet(F.col(text), F.col("term")).alias("snippet"))


#: Characters of a gram of the lexicon.
GRAM = 3
#: Entries of one row of the index.
LIST = 1024
#: Stands behind the last characters of a word, so that its end has grams too.
_PAD = "\0"


#: Input splits whose values may meet in one group before it is cut into lists.
SPLITS = 32
#: Files of a date's postings, for each SPLITS input splits.
BUCKETS = 8
#: A longer word is cut into grams by arrays, not by places.
SHORT = 64


@contextlib.contextmanager
def _sorted_groups(spark: SparkSession) -> Iterator[None]:
    """Groups of rows that are sorted already are collected in one pass, not sorted again by a partial and a final aggregate."""
    name = "spark.sql.execution.replaceHashWithSortAgg"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _lists(rows: DataFrame, by: Sequence[str], key: str, value: str, name: str, near: Sequence[str]) -> DataFrame:
    """``by``, ``first`` and ``name``: the sorted values of each group in arrays of at most LIST, and the first of the array.

    Rows are dealt once, by ``near`` (some of ``by``) and the bucket of ``key`` (one of ``by``). A group is collected from
    SPLITS input splits at a time.
    """
    part = F.expr(f"spark_partition_id() div {SPLITS} * {BUCKETS}") + F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    dealt = rows.withColumn("_part", part).repartition(*near, "_part").sortWithinPartitions(*by, "_part")
    grouped = dealt.groupBy(*by, "_part").agg(F.sort_array(F.collect_list(value)).alias("_all"))
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"(size(_all) - 1) div {LIST}")), lambda k: F.slice("_all", k * LIST + 1, F.lit(LIST)))
    lists = F.when(F.size("_all") <= LIST, F.array("_all")).otherwise(parts)
    return grouped.select(*by, F.explode(lists).alias(name)).withColumn("first", F.get(name, F.lit(0)))


def postings(items: DataFrame, report: Sequence[str], order: str, *columns: str, date: str = "date") -> DataFrame:
    """(report, word, first, items): the items of each report that hold each word of ``columns``, in lists of at most LIST.

    The rows of a ``date`` (one of ``report``) lie in BUCKETS partitions for each SPLITS input splits.
    """
    words = F.explode(F.array_distinct(F.split(search_text(*columns), r"(?U)\s+"))).alias("word")
    rows = items.select(*report, order, words).filter("word <> ''")
    # the word comes first, as Spark's sort tells most rows apart by eight bytes of the first column
    return _lists(rows, ["word", *report], "word", order, "items", [date]).select(*report, "word", "first", "items")


def grams(word) -> Column:
    """array<string>: the GRAM characters from each character of ``word`` on, the last ones padded; linear in its length."""
    def from_each(letters: Column) -> Column:
        ahead = lambda i, n: F.coalesce(F.get(letters, i + n), F.lit(_PAD))
        return F.transform(letters, lambda c, i: F.concat(c, *[ahead(i, n) for n in range(1, GRAM)]))

    return F.array_distinct(F.flatten(F.transform(F.array(F.split(word, "")), from_each)))  # the letters are bound once


def _with_grams(words: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``gram``, a row for each of the :func:`grams` of ``word``; words of up to SHORT characters need no arrays."""
    short = F.length("word") <= SHORT
    pieces = F.when(short, F.array(F.concat("word", F.lit(_PAD * (GRAM - 1))))).otherwise(grams(F.col("word")))
    places = F.when(short, F.greatest(F.length("word"), F.lit(1))).otherwise(1)
    cut = words.select(*columns, places.alias("_places"), F.explode(pieces).alias("_piece"))
    placed = cut.select(*columns, "_piece", F.explode(F.sequence(F.lit(1), "_places")).alias("_at"))
    found = placed.withColumn("gram", F.substring(F.col("_piece"), F.col("_at"), F.lit(GRAM)))
    return found.filter(F.instr("_piece", F.col("gram")) == F.col("_at")).select(*columns, "gram")  # the first of equal ones


def lexicon(words: DataFrame) -> DataFrame:
    """(gram, n, words): which distinct words of ``words`` (word) hold each whole gram, in lists of ``n``, at most LIST."""
    rows = _with_grams(words.select("word").distinct(), "word").filter(~F.endswith("gram", F.lit(_PAD)))
    return _lists(rows, ["gram"], "gram", "word", "words", ["gram"]).select("gram", F.size("words").alias("n"), "words")


def write_index(items: DataFrame, path: str, report: Sequence[str], order: str, *columns: str, date: str = "date") -> None:
    """The inverted index of ``items`` under ``path``: postings and first items of each gram, in a folder per ``date`` (one
    of ``report``), and a lexicon.

    A rerun replaces the dates that ``items`` holds, and no others; only the postings are made from texts, the first
    items and the lexicon from postings.
    """
    with _sorted_groups(items.sparkSession):
        write_by_date(postings(items, report, order, *columns, date=date), f"{path}/postings", date)
    kept = items.sparkSession.read.parquet(f"{path}/postings").select(*report, "word", "first")
    renewed = kept.join(written(items.select(date).distinct(), "dates"), date, "left_semi")
    gram = _with_grams(renewed, *report, "first").groupBy(*report, "gram").agg(F.min("first").alias("item"))
    write_by_date(gram.repartition(date), f"{path}/grams", date)
    with _sorted_groups(items.sparkSession):
        lexicon(kept).write.mode("overwrite").parquet(f"{path}/lexicon")


def words_by_lexicon(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, term) for every word of the lexicon ``entries`` (gram, n, words) that holds a term of at least GRAM characters.

    A term is sought under the rarest of its grams; the words listed there are verified.
    """
    asked = terms.select("term").distinct().filter(F.length("term") >= GRAM)
    own = asked.select("term", F.explode(F.filter(grams(F.col("term")), lambda g: ~g.endswith(_PAD))).alias("gram"))
    number = entries.groupBy("gram").agg(F.sum("n").alias("_n"))
    rarest = own.join(number, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    listed = entries.join(written(rarest, "rarest"), "gram").select("term", F.explode("words").alias("word"))
    return listed.filter(F.contains("word", "term")).select("word", "term")


def search_index(path: str, items: DataFrame, queries: DataFrame, query_id: str, report: Sequence[str], order: str, text: str) -> DataFrame:
    """:func:`search_batch` by an index that :func:`write_index` has written: no text is read but those of the results.

    A term of at most GRAM characters begins a gram, whose first item in each report is kept; a longer one is sought in
    the lexicon and its words in the postings.
    """
    spark = items.sparkSession
    asked = queries.select(query_id, F.posexplode("terms").alias("term_no", "term")).filter("term <> ''")
    terms = written(asked.select("term").distinct(), "terms")
    words = written(words_by_lexicon(spark.read.parquet(f"{path}/lexicon"), terms.filter(F.length("term") > GRAM)), "words")
    listed = spark.read.parquet(f"{path}/postings").select(*report, "word", F.col("first").alias(order))  # a column of each list, not the list
    long = listed.join(words, "word").select(*report, "term", order)
    begun = spark.read.parquet(f"{path}/grams").withColumn("term", F.explode(F.array(*[F.substring("gram", 1, n) for n in range(1, GRAM + 1)])))
    short = begun.join(terms.filter(F.length("term") <= GRAM), "term").select(*report, "term", F.col("item").alias(order))
    found = long.union(short).groupBy(*report, "term").agg(F.min(order).alias(order))
    return _first_hits(found, asked, items, query_id, report, order, text)


def join_cards_reports(cards: DataFrame, reports: DataFrame) -> DataFrame:
    """``cards`` (href) with the report whose date stands in the href; left join on the extracted date."""
    dated = cards.withColumn("date", F.try_to_date(F.nullif(F.regexp_extract("href", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd"))
    return dated.join(reports, "date", "left")
