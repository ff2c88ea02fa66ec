"""Dictionary-driven place attribution, rule predicates, themes and audit.

Keyword scans are higher-order functions over a dictionary literal, so a document is classified where it is
read, with no shuffle. ``keyword_hits`` is the join form for dictionaries too large for a literal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import occurrences
from broadsheet.operators.rules import MAX_TERMS, strings
from broadsheet.operators.segment import let

ALL_LAYERS = ("place", "city", "site")


def place_hits(text, dictionary: Sequence[tuple[str, str, str]]) -> Column:
    """array<struct<pos, place, layer>>: the keywords of ``dictionary`` (keyword, place, layer; in order) that stand in
    ``text``, bare place names first. The text is scanned once for all layers."""
    ranked = [d for own in (True, False) for d in dictionary if (d[2] == "place") == own]
    if not ranked:
        return F.array().cast("array<struct<pos:int,place:string,layer:string>>")
    words = F.array(*[F.struct(F.lit(k).alias("kw"), F.lit(p).alias("place"), F.lit(la).alias("layer")) for k, p, la in ranked])
    found = F.transform(words, lambda w: F.struct(F.instr(text, w["kw"]).alias("pos"), w["place"].alias("place"), w["layer"].alias("layer")))
    return F.filter(found, lambda h: h["pos"] > 0)


def places_of(hits, layers: Sequence[str] = ALL_LAYERS) -> Column:
    """array<string>: the distinct places of ``hits`` (see :func:`place_hits`) in ``layers``, by position, ties by name.

    A fold over the hits, which are computed once; naming them again inside a lambda would scan anew for every place.
    """
    own = F.filter(hits, lambda h: h["layer"].isin(*layers)) if set(layers) != set(ALL_LAYERS) else hits
    none = F.array().cast("array<struct<pos:int,place:string>>")
    bare = lambda h: F.struct(h["pos"].alias("pos"), h["place"].alias("place"))
    seen = lambda kept, h: F.exists(kept, lambda k: k["place"] == h["place"])
    first = F.aggregate(own, none, lambda kept, h: F.when(seen(kept, h), kept).otherwise(F.concat(kept, F.array(bare(h)))))
    return F.transform(F.array_sort(first), lambda h: h["place"])


def scan_places(text, dictionary: Sequence[tuple[str, str, str]], layers: Sequence[str] = ALL_LAYERS) -> Column:
    """array<string>: the distinct places whose keywords stand in ``text``, by position, ties by name.

    ``dictionary`` holds (keyword, place, layer) in order. A place's position is that of its first keyword, in
    dictionary order, that occurs; bare place names come before the keywords of the other layers. Overlapping
    keywords all count.
    """
    return places_of(place_hits(text, [d for d in dictionary if d[2] in layers]), layers)


#: Lengths of anchors: a keyword is sought by its first characters, as many as the greatest of these that it has.
ANCHORS = (1, 2, 4, 8, 16)
#: Characters of a text cut into one block, or as many as the longest keyword has.
BLOCK = 64
#: Most bits of the bitmap of anchors, which has 64 or more a keyword up to there.
FILTER_BITS = 1 << 28


def keyword_hits(items: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """``items`` joined with each row of ``keywords`` (kw, ...) whose kw stands in ``text``, and its position.

    The join form of the scan. Up to MAX_TERMS keywords are broadcast and compared with every text; more go through
    :func:`keyword_hits_joined`, with the same result. An empty keyword stands nowhere.
    """
    if keywords.limit(MAX_TERMS + 1).count() > MAX_TERMS:
        return keyword_hits_joined(items, text, keywords)
    known = F.broadcast(keywords.filter("kw <> ''"))
    return items.join(known, F.contains(F.col(text), F.col("kw"))).withColumn("pos", F.instr(F.col(text), F.col("kw")))


def _bitmap(words: DataFrame, name: str, bits: int) -> DataFrame:
    """(_bucket, _bits array<long>): which of ``bits`` slots the hashes ``name`` of ``words`` take; 4 KB a row."""
    slots = words.select(F.pmod(name, F.lit(bits)).alias("_slot"))
    taken = slots.groupBy(F.shiftright("_slot", 15).cast("int").alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_slot") % 32768).alias("_bytes"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda k: F.conv(F.hex(F.substring(F.col("_bytes"), k * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    return taken.select("_bucket", whole.alias("_bits"))


def _possibly(rows: DataFrame, name: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """``rows`` without those whose hash ``name`` is surely not in ``bitmap``, which is broadcast."""
    slot = F.pmod(name, F.lit(bits))
    joined = rows.join(F.broadcast(bitmap), F.shiftright(slot, 15).cast("int") == F.col("_bucket"))
    at = (slot % 32768).cast("int")
    # A long holds eight bytes, the first of them highest; a byte's bits count from its lowest.
    word, shift = F.get("_bits", F.shiftright(at, 6)), (7 - F.shiftright(at, 3) % 8) * 8 + at % 8
    return joined.filter(F.call_function("shiftright", word, shift).bitwiseAND(F.lit(1).cast("long")) == 1).drop("_bucket", "_bits")


def keyword_hits_joined(items: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """:func:`keyword_hits` for any number of keywords, in time linear in the texts' lengths.

    Texts travel once, equal ones as one, and are cut into blocks that reach as far into the next as the longest keyword.
    At each character of a block the hash of the piece that begins there, one for each anchor length in use, is looked up in a
    broadcast bitmap of the keywords' anchors; only what may be one is shuffled, with as many characters as a keyword of
    that anchor can have, and met with the keywords by an equality join and verified. So the shuffle grows with the hits,
    not with the characters. The least position of a keyword in a text is kept, by the text's digest.
    """
    keywords = keywords.filter("kw <> ''")
    size = F.length("kw")
    anchor = F.greatest(*[F.when(size >= n, F.lit(n)) for n in ANCHORS])
    shape = keywords.agg(F.max(size), F.array_sort(F.collect_set(anchor)), F.count(F.lit(1))).first()  # one row, as many values as ANCHORS
    longest, lengths, bits = shape[0] or 1, shape[1] or [1], min(max(1 << (64 * shape[2]).bit_length(), 1 << 15), FILTER_BITS)
    digest = F.unhex(F.md5(text))
    block = max(BLOCK, longest - 1)
    pieces_of = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))

    def reaching(cut: Column) -> Column:
        ahead = lambda i: F.substring(F.coalesce(F.get(cut, i + 1), F.lit("")), 1, longest - 1)
        return F.transform(cut, lambda own, i: F.struct(i.alias("_no"), F.concat(own, ahead(i)).alias("_block"), F.length(own).alias("_own")))

    # The outer form keeps the optimizer from testing the array's size first, which would cut the text again.
    texts = items.select(digest.alias("_of"), F.col(text)).dropDuplicates(["_of"])
    blocks = texts.select("_of", F.explode_outer(let(pieces_of, reaching)).alias("_b")).filter("_b IS NOT NULL").select("_of", "_b.*")
    starts = blocks.select("_of", "_no", "_block", F.explode(F.sequence(F.lit(1), F.col("_own"))).alias("_at"))
    hashes = F.array(*[F.xxhash64(F.lit(n), F.substring(F.col("_block"), F.col("_at"), F.lit(n))) for n in lengths])
    sought = keywords.groupBy(*keywords.columns).agg(F.count(F.lit(1)).cast("int").alias("_rows"))  # equal rows each count
    sought = sought.withColumn("_anchor", F.xxhash64(anchor, F.substring(F.col("kw"), F.lit(1), anchor)))
    anchored = _possibly(starts.select("*", F.posexplode(hashes).alias("_n", "_anchor")), "_anchor", _bitmap(sought, "_anchor", bits), bits)
    most = F.get(F.array(*[F.lit(min(2 * n - 1, longest) if n < ANCHORS[-1] else longest) for n in lengths]), "_n")  # of a keyword with that anchor
    place = (F.col("_no").cast("long") * block + F.col("_at")).cast("int")
    few = anchored.select("_of", "_anchor", place.alias("pos"), F.coalesce(F.substring(F.col("_block"), F.col("_at"), most), F.lit("")).alias("_piece"))
    met = few.join(sought, "_anchor").filter(F.startswith("_piece", "kw"))
    hits = met.groupBy("_of", *keywords.columns, "_rows").agg(F.min("pos").alias("pos"))
    found = hits.select("_of", *keywords.columns, "pos", F.explode(F.array_repeat(F.lit(1), F.col("_rows")))).drop("col")
    return items.withColumn("_of", digest).join(found, "_of").drop("_of")


def matches_rules(title, tags, title_words: Sequence[str] = (), tag_words: Sequence[str] = ()) -> Column:
    """A tag equals one of ``tag_words`` or the title contains one of ``title_words``."""
    by_tag = F.arrays_overlap(tags, strings(tag_words)) if tag_words else F.lit(False)
    by_title = F.exists(strings(title_words), lambda w: F.contains(title, w)) if title_words else F.lit(False)
    return F.coalesce(by_tag, F.lit(False)) | F.coalesce(by_title, F.lit(False))


def matches_rules_joined(items: DataFrame, key: str, title_words: DataFrame, tag_words: DataFrame, name: str) -> DataFrame:
    """``items`` (title, tags) with the boolean ``name``: :func:`matches_rules` with tables (kw) of any size.

    ``key`` is unique in ``items`` and not null. Only keys travel back: those of a title hit and of an equal tag.
    """
    titles = keyword_hits(items.select(F.col(key).alias("_key"), F.col("title").alias("_text")), "_text", title_words.select("kw").distinct())
    tags = items.select(F.col(key).alias("_key"), F.explode("tags").alias("kw")).join(tag_words.select("kw").distinct(), "kw", "left_semi")
    found = titles.select("_key").union(tags.select("_key")).distinct().withColumn("_found", F.lit(True))
    return items.join(found, items[key] == found["_key"], "left").withColumn(name, F.coalesce("_found", F.lit(False))).drop("_key", "_found")


def rule_flags(items: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """``items`` with the booleans _outreach, _strong and _weak by a table ``rules`` (rule_set, kw) of any size."""
    words = {name: rules.filter(F.col("rule_set") == name) for name in ("outreach_title", "outreach_tag", "strong_policy", "weak_national")}
    flagged = matches_rules_joined(items, key, words["outreach_title"], words["outreach_tag"], "_outreach")
    flagged = matches_rules_joined(flagged, key, words["strong_policy"], words["strong_policy"], "_strong")
    return matches_rules_joined(flagged, key, words["weak_national"], words["weak_national"], "_weak")


def attribute_places(items: DataFrame, dictionary, rules: dict[str, Sequence[str]], max_body: int = 2) -> DataFrame:
    """``items`` (title, tags, body) with ``places`` and ``tier``; the first tier that fits decides:

    title, tags, outreach (no place), strong policy (no place: national), place names and sites in the body
    (at most ``max_body``), weak national (no place), any body hit including cities (at most ``max_body``: body),
    unassigned. ``rules`` has outreach_tag, outreach_title, strong_policy and weak_national.
    """
    title, joined, body = _scanned_texts()
    hits = items.withColumns({"_title": scan_places(title, dictionary), "_tags": scan_places(joined, dictionary), "_hits": place_hits(body, dictionary)})
    scanned = hits.withColumns({"_site": places_of(F.col("_hits"), ("place", "site")), "_body": places_of(F.col("_hits"))})
    return _by_tiers(scanned.drop("_hits"), rules, max_body)


def attribute_places_joined(items: DataFrame, key: str, places: DataFrame, rules: dict[str, Sequence[str]] | DataFrame, max_body: int = 2) -> DataFrame:
    """:func:`attribute_places` with a dictionary of any size, the table ``places`` (kw, place, layer, ord).

    ``rules`` may be a table (rule_set, kw) of any size too. ``key`` is unique in ``items`` and not null. Hits are found by :func:`keyword_hits`, reduced to a position per
    (item, text, place) before the shuffle, and joined back; an item takes a list no longer than its own hits.
    """
    title, joined, body = _scanned_texts()
    texts = F.stack(F.lit(3), F.lit("title"), title, F.lit("tags"), joined, F.lit("body"), body).alias("_part", "_text")
    hits = keyword_hits(items.select(F.col(key).alias("_key"), texts), "_text", places)
    rank = F.struct((F.col("layer") != "place").alias("other"), "ord", "pos")  # bare place names come first
    firsts = hits.groupBy("_key", "_part", "place").agg(F.min(rank).alias("_any"), F.min(F.when(F.col("layer") != "city", rank)).alias("_near"))
    at = {name: F.when(F.col("_part") == part, F.struct(F.col(f"{of}.pos").alias("pos"), "place")) for name, part, of in (
        ("_title", "title", "_any"), ("_tags", "tags", "_any"), ("_body", "body", "_any"))}
    at["_site"] = F.when((F.col("_part") == "body") & F.col("_near").isNotNull(), F.struct(F.col("_near.pos").alias("pos"), "place"))
    lists = firsts.groupBy("_key").agg(*[F.transform(F.array_sort(F.collect_list(c)), lambda h: h["place"]).alias(n) for n, c in at.items()])
    none = F.array().cast("array<string>")
    scanned = items.join(lists, items[key] == lists["_key"], "left").drop("_key").withColumns({n: F.coalesce(n, none) for n in at})
    return _by_tiers(rule_flags(scanned, key, rules) if isinstance(rules, DataFrame) else scanned, rules, max_body)


def _scanned_texts() -> tuple[Column, Column, Column]:
    """Title, joined tags and body, as they are scanned."""
    return F.col("title"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), F.coalesce("body", F.lit(""))


def _by_tiers(scanned: DataFrame, rules: dict[str, Sequence[str]] | DataFrame, max_body: int) -> DataFrame:
    """``scanned`` (_title, _tags, _site, _body: places) with ``tier`` and ``places``; a table of rules has been joined before."""
    title, tags = F.col("title"), F.coalesce("tags", F.array().cast("array<string>"))
    if isinstance(rules, DataFrame):
        outreach, strong, weak = F.col("_outreach"), F.col("_strong"), F.col("_weak")
    else:
        outreach = matches_rules(title, tags, rules.get("outreach_title", ()), rules.get("outreach_tag", ()))
        strong = matches_rules(title, tags, rules.get("strong_policy", ()), rules.get("strong_policy", ()))
        weak = matches_rules(title, tags, rules.get("weak_national", ()), rules.get("weak_national", ()))
    none = F.array().cast("array<string>")
    some = lambda c: F.size(c) > 0
    tiers = [
        (some("_title"), "title", F.col("_title")), (some("_tags"), "tags", F.col("_tags")), (outreach, "outreach", none), (strong, "national", none),
        (some("_site"), "site", F.slice("_site", 1, max_body)), (weak, "national", none), (some("_body"), "body", F.slice("_body", 1, max_body)),
    ]
    tier, places = F.lit("unassigned"), none
    for test, name, value in reversed(tiers):
        tier, places = F.when(test, F.lit(name)).otherwise(tier), F.when(test, value).otherwise(places)
    return scanned.withColumn("tier", tier).withColumn("places", places).drop("_title", "_tags", "_site", "_body", "_outreach", "_strong", "_weak")


def themes_of(tags, themes: Sequence[tuple[str, str]]) -> Column:
    """array<string>: for each tag the first theme, in the order of ``themes`` (theme, word), with a word inside the tag."""
    words = F.array(*[F.struct(F.lit(t).alias("theme"), F.lit(w).alias("word")) for t, w in themes])
    first = F.transform(tags, lambda tag: F.get(F.filter(words, lambda w: F.contains(tag, w["word"])), F.lit(0))["theme"])
    return F.array_distinct(F.filter(first, lambda t: t.isNotNull()))


def themes_joined(items: DataFrame, key: str, tags: str, themes: DataFrame) -> DataFrame:
    """``items`` with ``themes``: :func:`themes_of` with a table (theme, theme_ord, word) of any size.

    ``key`` is unique in ``items`` and not null; each distinct tag is searched once, whatever the number of its items.
    """
    tagged = items.select(F.col(key).alias("_key"), F.posexplode(tags).alias("_no", "_tag"))
    words = themes.select("theme", "theme_ord", F.col("word").alias("kw"))
    hits = keyword_hits(tagged.select("_tag").filter(F.col("_tag").isNotNull()).distinct(), "_tag", words)
    theme_of = hits.groupBy("_tag").agg(F.min_by("theme", F.struct("theme_ord", "theme")).alias("_theme"))
    lists = tagged.join(theme_of, "_tag").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_no", "_theme"))).alias("_found"))
    joined = items.join(lists, items[key] == lists["_key"], "left")
    found = F.coalesce(F.array_distinct(F.transform("_found", lambda h: h["_theme"])), F.array().cast("array<string>"))
    return joined.withColumn("themes", found).drop("_key", "_found")


def emphasis_weight(title, marker: str) -> Column:
    """1 and one more for each ``marker`` in the title."""
    return 1 + occurrences(title, marker)


def audit_rows(attributed: DataFrame) -> DataFrame:
    """``attributed`` with ``kind``: prov, multi (several places), national or unassigned, and ``place_list``."""
    n = F.size("places")
    kind = F.when(n > 1, "multi").when(n == 1, "prov").when(F.col("tier") == "unassigned", "unassigned").otherwise("national")
    return attributed.withColumn("kind", kind).withColumn("place_list", F.array_join("places", "/"))


def review_queue(audit: DataFrame, width: int = 36) -> DataFrame:
    """The rows worth a look: weak tiers and several places, with a short title."""
    return audit.filter(F.col("tier").isin("site", "body", "unassigned") | (F.col("kind") == "multi")).withColumn("title", F.substring("title", 1, width))


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
