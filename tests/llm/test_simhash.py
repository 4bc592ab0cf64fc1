"""SimHash and the self-join of tries against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from flowspark.llm import simhash
from flowspark.llm.simhash import fingerprint, fingerprint_links, simhash_duplicates, stars, traverse
from tests.llm.test_pairs import classes, family


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(x, y):
    return (x ^ y).bit_count() <= 2


def expected(rows):
    """Component of each document; rows that repeat an id are one document."""
    prints = {}
    for d, t in rows:
        if d is not None:
            prints.setdefault(d, set()).add(slow_fingerprint(t))
    return classes(prints, lambda x, y: any(near(p, q) for p in x for q in y))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "Two words", "A  b\tC", "É   x y z é", "w " * 5000, "a b c d e f g"])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_long_text_counts_every_shingle(monkeypatch):
    monkeypatch.setattr(simhash, "HASHED", 7)
    text = " ".join(f"w{k * k % 91}" for k in range(200))
    assert fingerprint(text) == slow_fingerprint(text)


def test_equals_brute_force(documents_of, odd_rows):
    rows = family(3) + odd_rows + [(9000 + k, t) for k, (_, t) in enumerate(family(3)[:40])]
    got = simhash_duplicates(documents_of(rows)).collect()
    assert sorted((r.doc_id or 0, r.fingerprint) for r in got) == sorted((d or 0, f"{slow_fingerprint(t):016x}") for d, t in rows)
    want = expected(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(d, want[d]) if d is not None else (None, None) for d, _ in rows}


def test_empty_table(documents_of):
    assert simhash_duplicates(documents_of([])).collect() == []


def clusters(rng, bits=64, centres=60, each=25):
    """Fingerprints around a few centres, many of them two or three bits apart, and some at the ends of the range."""
    found = {0, 1, 3, 7, 2**64 - 1, 2**63, 2**63 + 1}
    for _ in range(centres):
        c = rng.getrandbits(bits)
        for _ in range(each):
            x = c
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(bits)
            found.add(x)
    return sorted(found)


def links_of(codes):
    return {(a, b) for k, a in enumerate(codes) for b in codes[k + 1 :] if near(a, b)}


def test_traversal_finds_every_pair_once(monkeypatch):
    codes = clusters(random.Random(1))
    for frontier in (1 << 18, 5):
        monkeypatch.setattr(simhash, "FRONTIER", frontier)
        found = [p for part in traverse(np.array(codes, np.uint64), np.array([[0, len(codes), 0, len(codes)]])) for p in part.T.tolist()]
        pairs = [tuple(sorted((codes[a], codes[b]))) for a, b in found]
        assert len(pairs) == len(set(pairs)) and set(pairs) == links_of(codes)


@pytest.mark.parametrize("leaf", [1 << 14, 20])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, leaf):
    """With small leaves the pairs of nodes are split over several rounds; a hot node holds most fingerprints."""
    rng = random.Random(leaf)
    hot = 0x5A5A5 << 43
    codes = clusters(rng, centres=12, each=15) + [x & (2**43 - 1) | hot for x in clusters(rng, 43, 12, 15)]
    codes = sorted(set(codes))
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rows = [(c - 2**64 if c >= 2**63 else c, k) for k, c in enumerate(codes)]
    got = fingerprint_links(spark.createDataFrame(rows, "fp long, id long")).collect()
    parent = {k: k for k in range(len(codes))}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        a, b = sorted((top(r.a), top(r.b)))
        parent[b] = a
    assert {k: top(k) for k in parent} == classes(dict(enumerate(codes)), near)


def test_stars_keep_components():
    a, b = stars(np.array([5, 9, 9, 3, 3]), np.array([7, 7, 2, 3, 4]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 5), (2, 7), (2, 9), (3, 4)]
