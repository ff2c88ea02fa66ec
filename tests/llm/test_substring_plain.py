"""Substring dedup against a version that goes through a table byte by byte and chunk by chunk."""

import random

from broadsheet.llm import substring

SPACE = set(b" \t\n\x0b\x0c\r")


def plain_chunks(data, spacing):
    chunks, start, run = [], 0, 0
    for i, byte in enumerate(data):
        gear = sum(int(substring.GEAR[data[i - j]]) << j for j in range(min(16, i + 1))) % 65536
        run = 0 if byte in SPACE else run + 1
        following = data[i + 1] if i + 1 < len(data) else 0x20
        at_word = byte in SPACE and following not in SPACE and gear < 65536 // spacing
        inside = run >= substring.LONG_WORD and gear < 65536 // substring.LONG_CUT and following & 0xC0 != 0x80 and following not in SPACE
        if at_word or inside or i + 1 == len(data):
            chunks.append(data[start : i + 1])
            start = i + 1
    return chunks


def words(data):
    return sum(1 if len(w) <= substring.LONG_WORD else len(w) // substring.WORD_BYTES for w in data.split())


def plain_dedup(rows, spacing=5, min_words=20):
    cut = [plain_chunks((t or "").encode(), spacing) for _, t in rows]
    first = {}
    for (key, _), chunks in zip(rows, cut, strict=True):
        for chunk in chunks if key is not None else ():
            first[chunk] = min(first.get(chunk, key), key)
    result = []
    for (key, text), chunks in zip(rows, cut, strict=True):
        kept, run = [], []
        for chunk in [*chunks, None]:
            if chunk is not None and chunk in first and (key is None or first[chunk] < key):
                run.append(chunk)
                continue
            passage = b"".join(run)
            kept += [] if words(passage) >= min_words else run
            run = []
            kept += [chunk] if chunk is not None else []
        result.append((key, None if text is None else b"".join(kept).decode()))
    return sorted(map(repr, result))


def test_a_table_equals_the_plain_version(spark):
    dice = random.Random(7)
    word = lambda: "".join(dice.choice("abcdeé日🔥") for _ in range(dice.randrange(1, 9)))
    passage = lambda n: dice.choice([" ", "\n", "  "]).join(word() for _ in range(n))
    shared = [passage(n) for n in (8, 25, 60, 120, 400)] + ["x" * 900, "日本" * 300]
    rows = []
    for i in range(120):
        parts = [passage(dice.randrange(0, 60)) for _ in range(dice.randrange(1, 4))]
        for _ in range(dice.randrange(3)):
            parts.insert(dice.randrange(len(parts) + 1), dice.choice(shared))
        rows.append((i, " ".join(parts)))
    rows += [(None, shared[3] + " tail"), (None, "alone " + shared[2]), (200, None), (201, ""), (7, rows[90][1]), (90, rows[90][1]), (202, shared[4] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = substring.dedup_substrings(docs).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in found) == plain_dedup(rows)
    before = {}
    for key, text in rows:
        before.setdefault(key, []).append(text)
    changed = 0
    for r in found:
        removed = sum(s.end - s.start for s in r._spans)
        assert len(r.text or "") + removed in [len(t or "") for t in before[r.doc_id]]
        changed += removed > 0
    assert changed > 20
