"""Shards, order-preserving fingerprints and co-training against plain versions of the same methods."""

import math
import random
import struct

import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

from broadsheet.llm import mixing, orderhash, pagetext, quality, sharding, simhash
from tests.llm.test_quality import SCHEMA, corpus


def chained(*values, seed=42):
    """Spark's xxhash64 of several columns, unsigned: each value is hashed with the hash before it as the seed."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_shard(key, shards):
    def descend(children):
        """The child, of (name, weight, what), with the smallest draw."""
        u = lambda name: ((chained(key, name.encode()) >> 11) + 0.5) * 2.0**-53
        return min(children, key=lambda c: -math.log(u(c[0])) / c[1])[2]

    for level in ("region", "rack"):
        names = list(dict.fromkeys(getattr(s, level) for s in shards))
        groups = [[s for s in shards if getattr(s, level) == n] for n in names]
        shards = descend([(n, sum(s.weight for s in g), g) for n, g in zip(names, groups, strict=True)])
    return descend([(f"{s.rack}/{s.number}", s.weight, s.number) for s in shards])


def test_shards_equal_a_plain_descent(spark):
    keys = [None, 0, -1, 2**62, *range(1, 1500)]
    docs = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    uneven = [sharding.Shard(s.region, s.rack, s.number, 1 + s.number % 3) for s in sharding.layout(17, 3, 2, 2)]
    for shards in (sharding.layout(40), sharding.layout(41), uneven):
        found = sharding.assign_shards(docs, shards).collect()
        assert [r.shard for r in found] == [plain_shard(r.doc_id, shards) for r in found]


def plain_sketches(text, k=3, sketches=32, select=2):
    tokens = [t.encode() for t in regex.findall(r"[\p{L}\p{N}]{1,8}|[^ \t\n\x0b\f\r\p{L}\p{N}]", text or "")]
    if not tokens:
        return [0] * sketches
    seen, numbered = {}, []
    for place in range(max(len(tokens) - k + 1, 1)):
        value = chained(*tokens[place : place + k]) >> 32
        nth = seen[value] = seen.get(value, -1) + 1
        if nth:  # a k-mer that occurred before
            value = xxhash.xxh64_intdigest(struct.pack("<i", nth - 1), chained(value)) >> 32
        numbered.append((value, place))
    out = []
    for i in range(sketches):
        rotated = sorted(numbered, key=lambda x: ((x[0] - i * 2**32 // sketches) % 2**32, x[1]))
        chosen = sorted((rotated[s % len(rotated)] for s in range(select)), key=lambda x: (x[1], x[0]))
        out.append(signed(chained(*[value for value, _ in chosen])) >> 32)
    return out


def test_fingerprints_equal_plain_ones(spark):
    dice = random.Random(4)
    word = lambda: "".join(dice.choice("abcé日") for _ in range(dice.randrange(1, 3)))
    texts = [None, "", "  ", "one", "one two", "one two three", "a b c d " * 40, "x" * 100, "!?! ... !?!", "long " * 50_000 + "end"]
    texts += [" ".join(word() for _ in range(dice.randrange(1, 120))) for _ in range(120)]
    rows = orderhash.with_sketches(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", "s").orderBy("id").collect()
    for r in rows:
        assert r.s == plain_sketches(r.text), r.id


def plain_training(rows, known, rounds, grow):
    """Co-training over a list of documents, with loops for the search of pseudo-labels."""
    vectors = {}
    for i, text, lang, source, n, _ in rows:
        vectors[i] = {"content": quality.content_features(text or "").astype(float), "metadata": quality.metadata_features(lang, source, n).astype(float)}
    ids = sorted(known)
    part = {i: xxhash.xxh32_intdigest(str(i)) % 8 for i in ids}
    adjust, choose = [i for i in ids if part[i] == 0], [i for i in ids if part[i] == 1]
    prior = sum(known.values()) / len(known)
    odds = math.log(prior / (1 - prior))
    x = lambda view, some: np.array([vectors[i][view] for i in some])
    y = lambda some: np.array([float(known[i]) for i in some])
    taught = {v: [(i, float(known[i])) for i in ids if part[i] > 1] for v in ("content", "metadata")}

    def fit():
        views, tried = {}, []
        for v, pairs in taught.items():
            views[v] = quality.fit_view(x(v, [i for i, _ in pairs]), np.array([label for _, label in pairs]))
            quality.calibrate(views[v], x(v, adjust), y(adjust))
        for weights in quality.WEIGHTS:
            both = lambda some, w=weights: odds + sum(k * (views[v].log_odds(x(v, some)) - odds) for k, v in zip(w, views, strict=True))
            tried.append((quality.row_losses(both(choose), y(choose)), both))
        weights = quality.chosen_weights(dict(zip(quality.WEIGHTS, (t[0] for t in tried), strict=True)))
        loss, both = tried[quality.WEIGHTS.index(weights)]
        return loss.mean(), views, both

    fitted, given = [fit()], set()
    for _ in range(rounds):
        lessons = {"content": [], "metadata": []}
        for teacher, pupil in (("content", "metadata"), ("metadata", "content")):
            chance = {i: 1 / (1 + math.exp(-float(fitted[-1][1][teacher].log_odds(x(teacher, [i]))[0]))) for i in vectors if i not in known}
            low, high = prior - quality.CONFIDENT * prior, prior + quality.CONFIDENT * (1 - prior)
            for label, count, sure in ((1.0, grow[0], lambda p, high=high: p >= high), (0.0, grow[1], lambda p, low=low: p <= low)):
                ranked = sorted((i for i, p in chance.items() if sure(p) and (i, teacher) not in given), key=lambda i: (-chance[i] if label else chance[i], i))
                given |= {(i, teacher) for i in ranked[:count]}
                lessons[pupil] += [(i, chance[i]) for i in ranked[:count]]
        for v, more in lessons.items():
            taught[v] += more
        fitted.append(fit())
    return min(fitted, key=lambda f: f[0])[2]


def test_training_equals_a_plain_version(spark):
    rows = corpus(500)
    known = {i: int(i % 5 > 0) for i, *_ in rows if i % 3 == 0}
    model, _ = quality.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(known.items()), "doc_id long, quality int"), rounds=2, grow=(40, 10))
    both = plain_training(rows, known, 2, (40, 10))
    found = {r.doc_id: r._scores.quality for r in quality.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    ids = [i for i, *_ in rows]
    expected = 1 / (1 + np.exp(-both(ids)))
    assert np.abs(np.array([found[i] for i in ids]) - expected).max() < 1e-6


def test_very_long_texts(spark):
    long = "word and other words " * 150_000
    docs = spark.createDataFrame([(1, long, "s"), (2, long, "s"), (3, long[:-400], "t"), (4, "short", "t")], "doc_id long, text string, source string")
    plan = {r.doc_id: r._plan for r in mixing.plan_mix(docs).collect()}
    assert plan[1].size == 600_000 and plan[4].size == 1 and all(p.copies <= 3 for p in plan.values())
    assert sharding.with_slots(sharding.assign_shards(docs, sharding.layout(3))).filter("slot IS NOT NULL").count() == 4
    component = {r.doc_id: r._component for r in simhash.near_duplicates(docs, shingle=3, seeds=(42,), segments=2, most=3).collect()}
    assert component[1] == component[2] == 1 and component[4] == 4
    prints = {r.doc_id: r for r in orderhash.compare_with_edits(docs.select("doc_id", "text")).collect()}
    assert prints[1].n_chars == len(long) and prints[1].near_next == 1.0
    html = "<article><p>" + long + "</p></article><footer>end</footer>"
    text = pagetext.extract_text(spark.createDataFrame([(1, "http://h.example/1", html)], "page_id long, url string, html string")).first()._text
    assert text == long.strip()
    assert docs.select(F.max(F.length("text"))).first()[0] == len(long)
