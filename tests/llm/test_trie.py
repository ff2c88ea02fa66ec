"""The trie against a plain one built from nested prefixes, and against SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import queries, trie

DATA = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _plain(paths):
    """By prefix, for a dict of conversation to list of (role, text)."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix in sorted(members, key=len, reverse=True):
        leaves[prefix] += not children[prefix]
        saved[prefix] += (len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0
        if prefix:
            leaves[prefix[:-1]] += leaves[prefix]
            saved[prefix[:-1]] += saved[prefix]
    found = []
    for prefix, at in members.items():
        ends = ",".join(str(c) for c in sorted(at) if len(paths[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        found.append((min(at), len(prefix), parent, len(at), len(children[prefix]), leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, found))


def _turns(spark, paths):
    rows = [(c, n, role, text) for c, path in paths.items() for n, (role, text) in enumerate(path)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations_equal_the_plain_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "WIDTH", 3)
    monkeypatch.setattr(trie, "FAN", 2)
    dice = random.Random(seed)
    turn = lambda: (dice.choice(["user", "a"]), dice.choice(["x", "yy", "日本", ""]))
    paths = {dice.randrange(-50, 10_000): [turn() for _ in range(dice.choice([1, 2, 3, 4, 9, 20]))] for _ in range(150)}
    paths |= {20_000 + i: [("user", "copy")] * 7 for i in range(80)}  # one hot conversation
    paths[30_000] = [("user", str(i)) for i in range(300)]  # one long
    assert _rows(trie.prefix_trie(trie.turn_paths(_turns(spark, paths)))) == _plain(paths)


def test_shared_heads_nulls_and_ties(spark):
    rows = [
        (100, None, "user", "zero"), (100, 1, None, "one"), (100, 2, "user", None), (101, 0, "user", "own"), (102, 5, "a", "b"), (250, 0, "u", "t"),
        (None, 0, "user", "lost"), (103, 1, "a", "same"), (103, 1, "a", "same"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = {100: [("user", "zero"), ("", "one"), ("user", "")], 101: [("user", "own")], 102: [("a", "b")], 250: [("u", "t")], 103: [("a", "same")] * 2}
    head = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    rebuilt = {c: own.get(c - c % 100, [])[: head[c]] + path[head[c] :] for c, path in own.items()}
    assert [] in rebuilt.values()  # a conversation without turns
    of = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    paths = trie.with_shared_heads(trie.turn_paths(turns), F.col("conv_id") - F.col("conv_id") % 100, of, 5)
    assert _rows(trie.prefix_trie(paths)) == _plain(rebuilt)


def test_clashing_columns_and_empty_tables(spark):
    turns = spark.createDataFrame([(1, 0, "u", "t", 5, "x")], "conv_id long, turn long, role string, text string, path int, _turn string")
    assert len(_rows(trie.prefix_trie(trie.turn_paths(turns)))) == 2
    assert _rows(trie.prefix_trie(trie.turn_paths(turns.limit(0)))) == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    expected = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op12_trie']})").fetchall()
    assert _rows(queries.op12_trie(spark, DATA)) == sorted(map(repr, expected))
