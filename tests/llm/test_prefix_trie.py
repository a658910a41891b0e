"""The conversation trie against a plain walk over whole conversations."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from facetgraph.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, ends int"


def _plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[1], t[3]) for t in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = turns if c % 20 == 0 else own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
        ends[tuple(full[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        words = len(node[-1][1].split()) if node else 0  # the texts here hold ASCII white space only
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * words
    out = []
    for node, own in members.items():
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), len(children[node]), leaves[node], saved[node], digest))
    return sorted(map(str, out))


def _check(spark, rows):
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == _plain(rows)


def test_trie_equals_plain_walk(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 45), 61, 62, 100, 240, 241, -3, -20, -21]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None]), "x", 1))
    # long ones that share, stop early, branch late, and one alone; many equal ones; turns that tie; no number; no id
    for c in range(300, 320):
        rows += [(c, t, "user", f"w {t}", None, None) for t in range(12 if c % 2 else 8 + c % 3)] + ([(c, 99, "user", f"own {c}", "x", 1)] if c % 3 == 0 else [])
    rows += [(500, t, "user", "alone and long", "x", 1) for t in range(40)]
    rows += [(c, t, "user", "same", "x", 1) for c in range(1000, 1060) for t in range(2)]
    rows += [(700, 1, "b", "z", "x", 1), (700, 1, "a", "y", "x", 1), (700, 1, "a", "x", "x", 1), (700, None, "c", "first", "x", 1), (700, 1, "a", "x", "x", 1), (None, 1, "user", "none", "x", 1)]
    rng.shuffle(rows)
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    _check(spark, rows)
    monkeypatch.setattr(prefix_trie, "HOT", 3)
    _check(spark, rows)


def test_no_conversations_and_one(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    _check(spark, [(7, 0, None, None, None, None)])
    _check(spark, [(20, 0, "user", "a b", None, None), (20, 1, "user", "c", None, None)])


@pytest.mark.parametrize("conv", [21, 22, 23, 24])
def test_a_conversation_of_its_block_only(spark, conv):
    _check(spark, [(conv, i, "user", "hello there", None, None) for i in range(3)])
