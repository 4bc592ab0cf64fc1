"""The trie of conversation prefixes against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from flowspark.llm import prefix_trie
from flowspark.llm.prefix_trie import NO_IDS, extents, range_minima, sparse_table

CLASHING = "conv_id long, turn long, role string, text string, key string, block long, n_convs long, depth long, kind int"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(lender, [])[:h] + turns[h:]
    return out


def expected(rows):
    members = {}
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((c, len(turns) == d))
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c, last in sorted(own) if last)
        out.append((
            min(own)[0], len(p), min(members[p[:-1]])[0] if p else None, len(own), sum(len(q) == len(p) + 1 for q in below),
            sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def conversations(seed, count, hot=0.4):
    """Many share first turns, copies of one take the share ``hot``, some have no lender, some are long."""
    rng, rows = random.Random(seed), []
    copied = [("user", "hé llo"), ("bot", "yes"), ("user", "ok")]
    for c in rng.sample(range(-40, 4 * count), count):
        if rng.random() < hot:
            turns = copied[: rng.choice([3, 3, 3, 2, 1])] + [("user", "more")] * rng.choice([0, 0, 0, 7])
        else:
            turns = [(rng.choice(["user", "bot"]), rng.choice("abé")) for _ in range(rng.choice([1, 2, 3, 5, 9, 30]))]
        rows += [(c, k if rng.random() < 0.9 or k else None, role, text) for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


ODD = [(None, 0, "user", "no id"), (5, None, None, None), (5, 3, "user", ""), (7, 0, "", None), (8, 1, "user", "x" * 50000), (9, -2, None, "y"), (2**63 - 1, 0, "a", "b")]


def result(spark, rows):
    frame = spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], CLASHING)
    return sorted(map(tuple, prefix_trie.prefix_trie(frame).select(RESULT).collect()), key=str)


@pytest.mark.parametrize("bucket, block_rows, block_turns", [(8_000_000, 1 << 16, 1 << 17), (600, 1 << 16, 1 << 17), (8_000_000, 3, 1 << 17), (900, 50, 11)])
def test_equals_brute_force(spark, monkeypatch, bucket, block_rows, block_turns):
    """In one block and in many, where prefixes and copies go over several."""
    monkeypatch.setattr(prefix_trie, "BUCKET", bucket)
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block_turns)
    rows = conversations(bucket + block_rows, 150) + [r for r in ODD]
    assert result(spark, rows) == sorted(expected(rows), key=str)


def test_nothing_but_turnless_conversations(spark):
    """Without the lender's turns and with all own turns taken off, only the root is left."""
    c = next(k for k in range(10**6) if k % 5 and zlib.crc32(str(k).encode()) % 9 == 8)
    assert result(spark, [(c, 0, "user", "a"), (c, 1, "bot", "b")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "text")]])
def test_empty(spark, rows):
    assert result(spark, rows) == []


def test_turns_tell_roles_and_texts_apart(spark):
    rows = [(0, 0, "a", "bc"), (5, 0, "ab", "c"), (10, 0, "", "abc")]
    assert len(result(spark, rows)) == len(expected(rows)) == 4
    assert NO_IDS == hashlib.sha256(b"").hexdigest()


def test_extents_and_minima():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 65):
        lcp = rng.integers(0, 4, n - 1)
        levels = sparse_table(lcp)
        row, depth = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(5)))
        left, right = extents(levels, row, depth)
        for i, d, a, b in zip(row, depth, left, right):
            assert all(lcp[a:i] >= d) and all(lcp[i:b] >= d) and (a == 0 or lcp[a - 1] < d) and (b == n - 1 or lcp[b] < d)
        ids = rng.integers(0, 99, n)
        assert range_minima(sparse_table(ids), left, right).tolist() == [ids[a : b + 1].min() for a, b in zip(left, right)]
