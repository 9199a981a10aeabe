"""The prefix trie of conversations, against tries of plain Python dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from topicloom.llm import prefix_trie, queries  # noqa: E402, F401
from topicloom.llm.prefix_trie import NODE_COLUMNS, Parentheses  # noqa: E402
from topicloom.llm.registry import QUERIES  # noqa: E402

SCHEMA = "conv_id long, turn int, role string, text string, path string, key int, kind string"


def ordered(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}


def brute_nodes(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(sequences):
        for d in range(len(sequences[conv]) + 1):
            members[tuple(sequences[conv][:d])].append(conv)
        ends[tuple(sequences[conv])].append(conv)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, held in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(held) - 1) * words
    return sorted((
        held[0], len(node), members[node[:-1]][0] if node else None, len(held), kids[node],
        leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
    ) for node, held in members.items())


def found_nodes(df):
    return sorted((tuple(r[c] for c in NODE_COLUMNS) for r in df.collect()), key=repr)


def talks(seed=2):
    """Conversations with hot first turns, copies, prefixes of others and long ones."""
    draw = random.Random(seed)
    rows = []
    for conv in range(-40, 320):
        kind = draw.randrange(6)
        if kind == 0:
            turns = ["hot start", "same", "same again"]
        elif kind == 1:
            turns = ["hot start", *(draw.choice("abc") for _ in range(draw.randrange(4)))]
        elif kind == 2:
            turns = ["hot start", "same", "same again"][:draw.randrange(1, 4)]
        elif kind == 3:
            turns = [draw.choice("xy z") for _ in range(draw.randrange(1, 9))]
        elif kind == 4:
            turns = ["long", *(str(n // 7) for n in range(draw.randrange(30, 90)))]
        else:
            turns = [None, f"own {conv}"]
        rows += [(conv, n if n else None, draw.choice(["user", None]) if n > 3 else "user", t)
                 for n, t in enumerate(turns)]
    rows += [(None, 0, "user", "no id"), (5, 0, "user", "same number"), (5, 0, "user", "as this"),
             (7, 1, "user", "twice"), (7, 1, "user", "twice"), (400, 1, "u", "word " * 60_000)]
    return rows


@pytest.mark.parametrize("shard_turns", [1 << 17, 60, 1])
def test_trie_like_brute_force(spark, shard_turns):
    rows = talks()
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    lists = prefix_trie.stored(prefix_trie.turn_lists(frame), "turn-lists")
    found = prefix_trie.prefix_trie(lists, shard_turns=shard_turns)
    assert found.columns == list(NODE_COLUMNS)
    assert found_nodes(found) == sorted(brute_nodes(ordered(rows)), key=repr)


def test_query_like_brute_force(spark, tmp_path):
    # Without its base, a conversation shorter than the shared head has no turn left.
    short = next(c for c in range(1001, 1020) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [*talks(4), (short, 0, "user", "gone")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    own, rebuilt = ordered(rows), {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - int(np.fmod(conv, 20))
        rebuilt[conv] = own.get(base, [])[:h] + turns[h:]
    assert any(not turns for turns in rebuilt.values())
    found = QUERIES["op13_conversation_prefix_trie"](spark, str(tmp_path))
    assert found_nodes(found) == sorted(brute_nodes(rebuilt), key=repr)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.turn_lists(none)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=400), st.sampled_from([4, 256]))
def test_find_close_like_a_stack(steps, block):
    bits, depth = [1], 1
    for up in steps:
        bits += [1] * up
        depth += up
        down = min(depth - 1, up // 2 + 1)
        bits += [0] * down
        depth -= down
    bits += [0] * depth
    close, stack = {}, []
    for place, is_open in enumerate(bits):
        if is_open:
            stack.append(place)
        else:
            close[stack.pop()] = place
    kind = type("Small", (Parentheses,), {"BLOCK": block})
    tree = kind(np.array(bits, dtype=bool))
    places = np.array(sorted(close))
    assert tree.find_close(places).tolist() == [close[p] for p in places.tolist()]
    pairs = tree.pairs_in(places, tree.find_close(places))
    text = "".join("()"[1 - b] for b in bits)
    assert pairs.tolist() == [text[p:close[p] + 1].count("()") for p in places.tolist()]
