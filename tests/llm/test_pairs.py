"""Line dedup and MinHash near-dedup against brute force."""

import random
import re

import pytest

from flowspark.llm.groups import bucket_members, components
from flowspark.llm.line_dedup import dedup_lines, plain_line, repeated_lines
from flowspark.llm.near_dedup import near_duplicates


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def classes(items, similar):
    """Smallest member reachable of each item, by comparing all pairs."""
    parent = {i: i for i in items}
    order = sorted(items)
    for k, a in enumerate(order):
        for b in order[:k]:
            x, y = find(parent, a), find(parent, b)
            if x != y and similar(items[a], items[b]):
                parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in items}


def alike(percent):
    return lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def char_set(line):
    return {line} if len(line) < 8 else {line[k : k + 8] for k in range(len(line) - 7)}


def family(seed=4):
    """Texts with copies, near copies and copies of near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, made = [], []
    for k in range(160):
        if made and rng.random() < 0.6:
            words = list(rng.choice(made))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(rng.randrange(1, 120))]
        made.append(words)
        rows.append((1000 + k, "\n".join(" ".join(words[j : j + 15]) for j in range(0, len(words), 15))))
    rng.shuffle(rows)
    return rows


def test_near_duplicates_equal_brute_force(documents_of, odd_rows):
    rows = family() + odd_rows
    got = near_duplicates(documents_of(rows)).collect()
    assert len(got) == len(rows)
    sets = {}
    for d, t in rows:
        if d is not None and d != 55:
            sets[d] = word_set(t)
    expected = classes(sets, alike(85))
    seen = {r.doc_id: r for r in got if r.doc_id in sets}
    assert {d: r.component_id for d, r in seen.items()} == expected
    assert all(r.n_shingles == len(sets[d]) and r.kept == (expected[d] == d) for d, r in seen.items())
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert sorted(r.n_shingles for r in got if r.doc_id == 55) == [1, 1, 3]


def test_repeated_lines_equal_brute_force(documents_of, odd_rows):
    rows = family(9) + [(d, t) for d, t in odd_rows if d != 55]
    got = {(r.doc_id, n) for r in repeated_lines(documents_of(rows)).collect() for n in r.numbers}
    lines = {}
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if d is not None and plain_line(line):
                lines[d, n] = plain_line(line)
    label = classes({x: char_set(x) for x in set(lines.values())}, alike(80))
    first = {}
    for place in sorted(lines):
        first.setdefault(label[lines[place]], place)
    assert got == {p for p, line in lines.items() if first[label[line]] != p}


def test_dedup_lines_keeps_rows_and_columns(documents_of, odd_rows):
    docs = documents_of([(1, "one line\nshared line here"), (2, "shared line here\n\nanother"), *odd_rows])
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(odd_rows) + 2
    assert {r.doc_id: r.text for r in rows if r.doc_id in (1, 2)} == {1: "one line\nshared line here", 2: "\nanother"}
    assert [r.text for r in rows if r.doc_id == 50] == [None]
    assert sorted(str(r.text) for r in rows if r.doc_id is None) == sorted(str(t) for d, t in odd_rows if d is None)


@pytest.mark.parametrize("operator", [near_duplicates, repeated_lines, dedup_lines])
def test_empty_table(documents_of, operator):
    assert operator(documents_of([])).collect() == []


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(k, 100) for k in range(101, 140)] + [(200, 200), (7, 3)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 140)}}


def test_bucket_members_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(k % 5, k % 40) for k in range(200)] + [(9, 1), (9, 1), (8, 2)]
        got = sorted(map(tuple, bucket_members(spark.createDataFrame(rows, "key long, id long")).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted({(k % 5, k % 40) for k in range(200)})


@pytest.mark.parametrize("united", [2, 1 << 19])
def test_a_chain_needs_few_rounds(spark, monkeypatch, united):
    from flowspark.llm import groups

    rounds = []
    monkeypatch.setattr(groups, "UNITED", united)
    monkeypatch.setattr(groups, "written", lambda df, name, write=groups.written: rounds.append(name) or write(df, name))
    links = [(i, i + 1) for i in range(40)] + [(60, 50), (50, 60), (70, 70), (80, 60)]
    found = groups.components(spark.createDataFrame(links[::3] + links[1::3] + links[2::3], "a long, b long").repartition(4))
    assert {r.id: r.label for r in found.collect()} == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 80: 50}
    assert found.count() == 44
    if united > 2:
        assert rounds.count("large-star") <= 1
