import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from foliospark.llm import prefix_trie as trie
from foliospark.llm.prefix_trie import NO_ENDS, conversations, prefix_trie, rebuilt

NAMES = {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"}
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, path string"


def sequences(rows):
    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            found[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in found.items()}


def with_openings(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def brute_force(turns_of):
    members = defaultdict(list)
    for c, turns in turns_of.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    found = set()
    for node, ids in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = sorted(c for c in ids if len(turns_of[c]) == len(node))
        found.add((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids),
            sum(len(m) == len(node) + 1 for m in below),
            sum(all(x[: len(m)] != m or len(x) == len(m) for x in below) for m in below),
            sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return found


def nodes_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def random_rows(n, seed=4):
    """Conversations over a small alphabet, so that many share openings or are the same."""
    chance = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(chance.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, chance.choice(["user", None]), chance.choice(["a", "bb", "c" * 40, None])))
    return rows


@pytest.mark.parametrize("block, merge", [(1 << 20, 4096), (600, 4096), (300, 3)])
def test_nodes_equal_brute_force(spark, monkeypatch, block, merge):
    """Also with blocks of a few rows, contracted again and again."""
    monkeypatch.setattr(trie, "BLOCK_BYTES", block)
    monkeypatch.setattr(trie, "MERGE_ROWS", merge)
    rows = random_rows(300)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert nodes_of(prefix_trie(rebuilt(df, NAMES))) == brute_force(with_openings(sequences(rows)))
    assert nodes_of(prefix_trie(conversations(df, NAMES))) == brute_force(sequences(rows))


def test_many_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "_PIECE", 50)
    monkeypatch.setattr(trie, "BROADCAST_NODES", 0)
    rows = [(c, t, "user", f"common {t}") for c in range(400) for t in range(3)]
    rows += [(1000, t, "user", f"common {t}") for t in range(500)] + [(1001, 0, "user", "other")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert nodes_of(prefix_trie(conversations(df, NAMES).repartition(40))) == brute_force(sequences(rows))


def test_nulls_ties_and_turnless_conversations(spark):
    # 3 has h = crc32("3") % 6 turns of 0, which is absent; what it has itself may all go
    rows = [(3, None, None, None), (3, 0, "user", ""), (3, 0, "user", "tie"), (7, 1, "a", "b"), (7, 1, "a", "b"),
            (None, 1, "user", "no conversation"), (200, None, "user", "é\U0001f600"), (205, 5, "user", "x"), (-5, 1, "u", "v")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    plain = sequences(rows)
    plain[3] = [("", ""), *[t[1:] for t in sorted(
        (hashlib.md5(f"4:user{text}".encode()).digest(), "user", text) for text in ("", "tie")
    )]]
    assert nodes_of(prefix_trie(conversations(df, NAMES))) == brute_force(plain)
    got = prefix_trie(rebuilt(df, NAMES)).where("depth = 0").collect()
    assert [(r["n_convs"], r["conv_id"], r["parent_conv_id"]) for r in got] == [(5, -5, None)]
    alone = spark.createDataFrame([(2, 0, "u", "v", 1, "x")], SCHEMA)
    assert zlib.crc32(b"2") % 6 > 0
    assert nodes_of(prefix_trie(rebuilt(alone, NAMES))) == {
        (2, 0, None, 1, 0, 1, 0, hashlib.sha256(b"2").hexdigest())
    }


def test_no_conversations_no_nodes(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(rebuilt(nothing, NAMES)).collect() == []
    assert NO_ENDS == hashlib.sha256(b"").hexdigest()
