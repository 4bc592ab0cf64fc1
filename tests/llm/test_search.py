"""WARC captures and exact top-k."""

import gzip
import math
import random

from flowspark.llm import topk
from flowspark.llm.topk import top_k
from flowspark.llm.warc import assemble_captures, parse_records, read_warc, resolve_revisits, write_warc


def captures(spark, tmp_path, rows):
    pages = spark.createDataFrame([(p, u, h, "x", 1) for p, u, h in rows], "page_id long, url string, html string, digest string, copy int")
    write_warc(pages, str(tmp_path / "warc"))
    return resolve_revisits(assemble_captures(read_warc(spark, str(tmp_path / "warc")))).collect()


def test_captures_round_trip(spark, tmp_path):
    rows = [
        (1, "http://a/", "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (2, None, None), (3, "http://c/ x\ny", ""), (4, "http://d/", "same"),
        (5, "http://e/", "same"), (5, "http://e/", "same"), (4, "http://d2/", "same"), (None, "http://n/", "same"), (7, "http://g/", "z" * 200_000),
    ]
    found = captures(spark, tmp_path, rows)
    assert len(found) == len(rows)
    page = lambda m: int(m[0].fields["page-id"]) if m and "page-id" in m[0].fields else None
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    for c in found:
        assert len(c.requests) == 1 and len(c.metadata) == 1
        assert c.payload_bytes is not None and len(c.response.payload_digest) == 32
    responses = {page(c.metadata): bytes(c.response.payload).decode() for c in found if c.response.type == "response"}
    assert responses == {p: h for h, p in first.items()}
    assert sorted(page(c.referred) for c in found if c.response.type == "revisit") == [2, 4, 4, 4, 4]
    assert sorted(c.payload_bytes for c in found) == sorted(len((h or "").encode()) for _, _, h in rows)


def test_records_of_single_gzip_members_and_plain_files():
    one = lambda n: f"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n"
    for content in (one(3) + one(0), gzip.compress(one(3)) + gzip.compress(one(0))):
        assert [block for _, block in parse_records(content)] == [b"xxx", b""]


def test_warc_of_empty_table(spark, tmp_path):
    assert captures(spark, tmp_path, []) == []


def brute_force(rows, k=20):
    ready = [
        (n, v, [math.floor(64 * x) for x in e]) for n, (v, e) in enumerate(rows)
        if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for n, q, a in ready:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), v) for m, v, b in ready if m != n)
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def vectors(spark, rows):
    frame = spark.createDataFrame([(v, e, 1, "x") for v, e in rows], "vec_id long, embedding array<double>, block long, lot string")
    return sorted(map(tuple, top_k(frame).collect()))


def test_top_k_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-2, 2) for _ in range(16)]) for k in range(300)]
    rows += [(300 + k, [1.0] * 16) for k in range(60)]  # ties
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 16), (460, [float("inf")] * 16), (None, [1.0] * 16), (480, []), (500, [3.0]), (20, [0.5] * 16)]
    assert vectors(spark, rows) == brute_force(rows)


def test_top_k_brings_no_table_to_the_driver(spark, monkeypatch):
    """What is exploded from a small file is lots x blocks: no broadcast, though the file is below the threshold."""
    plans, sizes = [], []

    def written(df, name, keep=topk.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = keep(df, name)
        if name == "vector-blocks":
            sizes.extend(r.n for r in out.select("n").collect())
        return out

    monkeypatch.setattr(topk, "written", written)
    rows = [(i, [((i * 7 + j) % 13) / 8 for j in range(4)]) for i in range(5000)]
    best = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=500)
    plans.append(best._jdf.queryExecution().executedPlan().toString())
    assert best.count() == 200
    assert "SortMergeJoin" in "".join(plans) and "Broadcast" not in "".join(plans)
    # Arrow batches of a thousand rows do not make blocks of a thousand.
    assert len(sizes) == 2 and sum(sizes) == 5000


def test_top_k_of_few_and_large(spark):
    rows = [(0, [3e6, -1.0]), (20, [3e6, 2.0]), (1, [2e6, 7.0])]  # products beyond what a double holds exactly
    assert vectors(spark, rows) == brute_force(rows)
    assert vectors(spark, []) == []
    assert vectors(spark, [(40, [1.0])]) == []
