"""Order MinHash document fingerprints, built-in functions only.

The text is a sequence of tokens (runs of letters and digits, cut every eight, and single other
characters). Its k-mers are numbered by occurrence, so repeats count, and each numbered k-mer gets one
hash value. Sketch i orders them by the hash rotated by i / sketches of its range, selects the smallest
``select`` of them, puts these back in text order and hashes the tuple. Two fingerprints agree in a
sketch only where the texts share the selected k-mers in the same order, which tracks edit distance
where a plain MinHash would not notice moved passages.

Defined results: null text counts as empty; texts without tokens (empty, white space) share one
fingerprint; a text shorter than a k-mer is one k-mer; equal texts have equal fingerprints. Places have 31 bits,
more than a string can hold tokens. k-mers are told apart by 32 bits: of a text's n k-mers a share of n / 2**32 is
taken for a repeat of another, alike in equal texts. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.scratch import in_order, materialize

TOKEN = r"[\p{L}\p{N}]{1,8}|[^\s\p{L}\p{N}]"
#: A numbered k-mer is one long: hash above, place below.
_PLACE_BITS, _HASH_BITS = 31, 32


def _packed(value: Column, place: Column) -> Column:
    kept = F.shiftrightunsigned(value, 64 - _HASH_BITS)
    return F.shiftleft(kept, _PLACE_BITS).bitwiseOR(place.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("long"))


def _value(packed: Column) -> Column:
    return F.shiftright(packed, _PLACE_BITS)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))


def _indices(array: str) -> Column:
    """0, 1, ... of the elements; none for an empty array."""
    return F.slice(F.sequence(F.lit(0), F.size(array)), F.lit(1), F.size(array))


def with_sketches(df: DataFrame, text: str, sketch: str, k: int = 3, sketches: int = 32, select: int = 2) -> DataFrame:
    """``df`` with ``sketch``: array<int>, one number per sketch (``sketches`` a power of two)."""
    kept = df.columns
    at = lambda array, i: F.get(F.col(array), i)
    tokens = df.select(*kept, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)).alias("_tokens"))

    first = F.slice(F.sequence(F.lit(0), F.greatest(F.size("_tokens") - k, F.lit(0))), F.lit(1), F.size("_tokens"))
    kmers = F.transform(first, lambda i: _packed(F.xxhash64(*[at("_tokens", i + j) for j in range(k)]), i))
    ordered = tokens.select(*kept, F.sort_array(kmers).alias("_kmers"))

    def repeats(i):
        return (i > 0) & (_value(at("_kmers", i)) == _value(at("_kmers", i - 1)))

    # The places in _kmers of second and later occurrences; equal k-mers are neighbours there.
    split = ordered.select(*kept, "_kmers", F.filter(_indices("_kmers"), repeats).alias("_again"))
    starts = F.filter(_indices("_again"), lambda t: (t == 0) | (at("_again", t) != at("_again", t - 1) + 1))
    split = split.select("*", starts.alias("_starts"))

    def numbered(start, r):
        stop = F.coalesce(F.get("_starts", r + 1), F.size("_again"))

        def hashed(t):
            one = at("_kmers", at("_again", t))
            return _packed(F.xxhash64(_value(one), t - start), _place(one).cast("int"))

        return F.transform(F.sequence(start, stop - 1), hashed)

    once = F.filter("_kmers", lambda x, i: (i == 0) | (_value(x) != _value(at("_kmers", i - 1))))
    later = F.flatten(F.transform("_starts", numbered))
    every = split.select(*kept, F.sort_array(F.concat(once, later)).alias("_all"))

    shift = _PLACE_BITS + _HASH_BITS - (sketches.bit_length() - 1)
    share = lambda x: F.shiftright(x, shift)
    opens = F.filter(_indices("_all"), lambda i: (i == 0) | (share(at("_all", i)) != share(at("_all", i - 1))))
    opened = every.select(*kept, "_all", opens.alias("_opens"))

    def sketch_of(i):
        begin = F.coalesce(F.get(F.filter("_opens", lambda o: share(at("_all", o)) >= i), F.lit(0)), F.lit(0))
        chosen = F.transform(F.sequence(F.lit(0), F.lit(select - 1)), lambda s: at("_all", F.pmod(begin + s, F.greatest(F.size("_all"), F.lit(1)))))
        in_text = F.array_sort(F.transform(chosen, lambda x: F.struct(_place(x).alias("place"), _value(x).alias("value"))))
        return F.shiftright(F.xxhash64(F.transform(in_text, lambda x: x["value"])), 32).cast("int")

    # The test also keeps the optimizer from writing _opens into the lambda, to be computed once per sketch.
    numbers = F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)), sketch_of)
    return opened.select(*kept, F.when(F.size("_opens") > 0, numbers).otherwise(F.array_repeat(F.lit(0), sketches)).alias(sketch))


def fingerprint_text(sketch: Column) -> Column:
    """Lowercase hex, eight digits per sketch."""
    digits = F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal sketches, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def successors(docs: DataFrame, tail: Column, key: str = "doc_id") -> DataFrame:
    """(_key, _next, _tail): each distinct key, the next greater one (after the last the first), its largest ``tail``."""
    keys = docs.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(tail).alias("_tail"))
    placed = in_order(keys, "_key", name="keys")
    following = F.lead("_key").over(Window.partitionBy("_part").orderBy("_row"))
    heads = placed.groupBy("_part").agg(F.min("_key").alias("_head"))
    over_parts = Window.orderBy("_part")  # as many rows as the sort has partitions
    wrapped = F.min("_head").over(over_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("_part", F.coalesce(F.lead("_head").over(over_parts), wrapped).alias("_after"))
    joined = placed.withColumn("_following", following).join(F.broadcast(heads), "_part")
    return joined.select("_key", F.coalesce("_following", "_after").alias("_next"), "_tail")


def compare_with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to it and to the next document.

    The edited text ends, in place of the last quarter of its code points, with as many of the next
    document's first. A row without a key has no next document (nothing replaces its last quarter, near_next
    is null); where a next key repeats, the smallest of its beginnings and of its sketches counts.
    """
    whole = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    quarter = F.floor(F.length("_text") / 4).cast("int")
    order = materialize(successors(whole, quarter, key="_key"), "successors")
    begin = order.select(F.col("_key").alias("_of"), F.col("_next").alias("_key"), "_tail")
    keyed, bare = whole.filter("_key IS NOT NULL"), whole.filter("_key IS NULL")  # both joins read one shuffle of the keyed rows
    heads = keyed.join(begin, "_key").groupBy("_of").agg(F.min(F.expr("substring(_text, 1, _tail)")).alias("_head"))
    edited = F.concat(
        F.expr("substring(_text, 1, length(_text) - floor(length(_text) / 4))"),
        F.expr("substring(coalesce(_head, ''), 1, cast(floor(length(_text) / 4) as int))"),
    )
    headed = keyed.join(heads, keyed["_key"] == heads["_of"], "left").select("_key", "_text", "_head")
    both = headed.union(bare.select("_key", "_text", F.lit(None).cast("string"))).select("_key", "_text", edited.alias("_edited"))
    printed = with_sketches(with_sketches(both, "_text", "_sketch", **options), "_edited", "_edited_sketch", **options)
    prints = materialize(
        printed.select("_key", F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "_sketch", "_edited_sketch"),
        "fingerprints",
    )
    next_sketch = prints.groupBy(F.col("_key").alias("_next")).agg(F.min("_sketch").alias("_next_sketch"))
    ahead = order.join(next_sketch, "_next").select(F.col("_key").alias("_of"), "_next_sketch")
    return prints.join(ahead, prints["_key"] == ahead["_of"], "left").select(
        F.col("_key").alias(key), "n_chars", "edited_sha256",
        fingerprint_text(F.col("_sketch")).alias("fingerprint"), fingerprint_text(F.col("_edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"), likeness(F.col("_sketch"), F.col("_next_sketch")).alias("near_next"),
    )
