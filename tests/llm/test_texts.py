"""Toxicity, language, templates, BPE and personal data."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from flowspark.llm import langid, toxicity
from flowspark.llm.bpe import Encoder, decode, encode_documents, read_ranks
from flowspark.llm.decontaminate import contaminated, drop_contaminated
from flowspark.llm.pii import KINDS, find_personal_data, sanitise

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.01"


# Byte-level BPE


@pytest.fixture(scope="module")
def tokens():
    return read_ranks(RANKS)


@pytest.fixture(scope="module")
def reference(tokens):
    ranks = {t: k for k, t in enumerate(tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_reproduces_merges(tokens, reference):
    rng, encoder = random.Random(1), Encoder(tokens)
    parts = ["a", "e", " ", "th", "ing", "\n", "é", "中", "0", "1", "==", "--", "😀", "z", "  ", "ion", "er", "'s", "\t", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text in [*texts, "a" * 3000, "ab" * 2000, "aaab" * 700, "中" * 900]:
        ids = [k for p in regex.findall(public_tokenizers.PATTERN, text) for k in encoder.encode(p.encode())]
        assert ids == reference.encode_ordinary(text)
        assert decode(np.array(ids, np.int64), tokens) == text.encode()


def test_bpe_of_documents(documents_of, odd_rows, reference):
    got = encode_documents(documents_of(odd_rows), RANKS, public_tokenizers.PATTERN).collect()
    ids = [reference.encode_ordinary(t or "") for _, t in odd_rows]
    key = lambda r: (str(r[0]), r[2])
    expected = [(d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (d, t), i in zip(odd_rows, ids)]
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(expected, key=key)
    assert sorted(r.ids for r in got) == sorted(ids)
    assert encode_documents(documents_of([]), RANKS, public_tokenizers.PATTERN).collect() == []


# Personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group())]


def test_base_spans_equal_brute_force(documents_of, odd_rows):
    rng = random.Random(2)
    parts = ["a", "b.", "@", "1", "25", "255", "300", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "_", "%", "\n", "é", "😀", "u@mail.com", "+1 (017) 555-7713", "10.0.0.1", "00001"]
    rows = [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for k in range(800)]
    rows += [(9000, "1" * 50000), (9001, "a" * 50000 + "@b.c"), (9002, "1." * 9000), (9003, "a@" * 9000), (9004, "+1" * 9000), (9005, "u@m.com " * 1500), *odd_rows]
    got = find_personal_data(documents_of(rows)).collect()
    spans = lambda r: [(k, m.start, m.end) for k in KINDS for m in r[k]]
    assert sorted((str(r.doc_id), spans(r)) for r in got) == sorted((str(d), base_spans(t)) for d, t in rows)


def test_revealing_words(documents_of):
    rows = [(k, f"Ask Winterbottom the auditor, mail w{k % 2}@corp.example.com for the ledger.") for k in range(8)]
    rows += [(100 + k, "Ask the auditor for the ledger, and mail for it.") for k in range(300)]
    found = {r.doc_id: r for r in find_personal_data(documents_of(rows)).collect()}
    words = lambda d: {rows[d][1][t.start : t.end]: t.action for t in found[d].terms}
    assert words(0)["Winterbottom"] in ("generalise", "remove") and "auditor" not in words(0)
    assert all(not found[100 + k].terms and not found[100 + k].email for k in range(300))
    clean = {r.doc_id: r.text for r in sanitise(documents_of(rows)).collect()}
    assert "Winterbottom" not in clean[0] and "[EMAIL]" in clean[0] and "corp" not in clean[0]
    assert clean[100] == rows[8][1]


def test_revealing_words_of_rare_entities(documents_of):
    far = "and so the people go on with their work for the day. " * 4
    rows = [(1, f"Ask Winterbottom for the work. {far}Mail w@corp.example.com."), (2, f"Call Oleander. {far}+1 (017) 555-7713, or +1 (017) 555-7713.")]
    rows += [(100 + k, f"Ask for the work and mail or call. {far}") for k in range(1000)]
    found = {r.doc_id: [rows[r.doc_id - 1][1][t.start : t.end] for t in r.terms] for r in find_personal_data(documents_of(rows)).collect() if r.terms}
    assert found == {1: ["Winterbottom"], 2: ["Oleander"]}


@pytest.mark.parametrize("count", [600, 2400, 9600])
def test_disclosure_is_not_rarity(documents_of, count):
    """Planted names among words that are as rare but unrelated, at three sizes of the corpus: found, and little else is."""
    rng = random.Random(count)
    code = lambda n: "".join("abcdefghij"[int(c)] for c in f"{n:06d}")
    rows, names = [], {}
    for k in range(count):
        words = ["the", "people", "write", "today"] + ["rare" + code(rng.randrange(count)) for _ in range(10)]
        if k % 25 < 3:  # an address in three documents, each time beside its owner's name
            owner = k // 25
            names[k] = "name" + code(owner)
            words += [names[k], f"{owner}@host{owner % 3}.example"]
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    texts = dict(rows)
    marked = {r.doc_id: {texts[r.doc_id][t.start : t.end] for t in r.terms} for r in find_personal_data(documents_of(rows)).collect()}
    right = sum(names[k] in marked[k] for k in names)
    wrong = sum(len(marked[k] - {names.get(k)}) for k in marked)
    assert right / len(names) > 0.95 and wrong / (right + wrong) < 0.05


def test_personal_data_of_empty_table(documents_of):
    assert find_personal_data(documents_of([])).collect() == []


# Benchmark templates

QUESTION = "Tom Smith buys 12 apples for 3 dollars each. How much does Tom Smith pay if he returns 2 of the 12 apples to the shop on the corner?"


def test_templates(spark, documents_of, odd_rows):
    items = spark.createDataFrame([(1, QUESTION, "x"), (2, "Short item of five words", "y"), (3, None, ""), (None, "no id", "")], "item_id long, text string, hash string")
    other = QUESTION.replace("12", "40").replace("Tom", "Ann").replace("Smith", "Jones").replace(" 3 ", " 7 ")
    rows = [
        (1, QUESTION), (2, "Well. " + other), (3, QUESTION.upper()), (4, "a b Short, item of five words c"), (5, "short item of five other words"),
        (6, " ".join(map(str, range(60)))), (7, "He buys 12 apples. How much does he pay?"), (None, "First. " + QUESTION), *odd_rows,
    ]
    found = contaminated(documents_of(rows), items).collect()
    assert {(r.doc_id, r.item_id, r.reworded) for r in found} == {(1, 1, False), (2, 1, True), (3, 1, False), (4, 2, False), (None, 1, False)}
    kept = drop_contaminated(documents_of(rows), items)
    assert kept.columns == documents_of([]).columns
    assert kept.count() == len(rows) - 5
    inconsistent = other.replace("of the 40 apples to", "of the 41 apples to")
    passages = contaminated(documents_of([(1, inconsistent)]), items).collect()
    assert all(r.words < r.item_words for r in passages)
    assert contaminated(documents_of([]), items).collect() == []
    assert contaminated(documents_of(rows), items.limit(0)).collect() == []


def test_one_changed_number(spark, documents_of):
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k + 100))
    cases = [(n, p) for n in range(9, 18) for p in range(n)]
    text = lambda k, n, p, v: " ".join(str(v) if j == p else word(20 * k + j) for j in range(n))
    items = spark.createDataFrame([(k, text(k, *c, 48)) for k, c in enumerate(cases)], "item_id long, text string")
    found = contaminated(documents_of([(k, text(k, *c, 36)) for k, c in enumerate(cases)]), items).collect()
    assert sorted((r.doc_id, r.item_id, r.words, r.reworded) for r in found) == [(k, k, n, max(p, n - 1 - p) < 13) for k, (n, p) in enumerate(cases)]


def test_names_without_telling_capitals(spark, documents_of):
    item = "Natalia sold 48 clips to her friends in town. Natalia then sold 24 more clips at the fair."
    other = item.replace("Natalia", "Maria").replace("48", "36").replace("24", "12")
    inside = "On Monday Natalia sold 48 clips to her friends in town and Natalia gave 24 more clips away."
    same = inside.replace("48", "36").replace("24", "12")
    items = spark.createDataFrame([(1, item), (2, inside)], "item_id long, text string")
    rows = [(1, other), (2, other.lower()), (3, other.title()), (4, same.lower()), (5, same.title()), (6, "Maria sold 36 clips.")]
    found = contaminated(documents_of(rows), items).collect()
    assert {(r.doc_id, r.item_id, r.words == r.item_words) for r in found} >= {(1, 1, True), (2, 1, True), (3, 1, True), (4, 2, True), (5, 2, True)}
    assert all(r.doc_id != 6 and r.reworded for r in found)


# Toxicity


def test_maximal_segments_equal_their_definition():
    rng = random.Random(1)

    def split(s, a, z):
        best = max(((sum(s[i:j]), -i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[1], best[2]
        return split(s, a, i) + [(i, j)] + split(s, j, z)

    for _ in range(300):
        s = [rng.choice([-2, -1, -0.5, 1, 2, 0.7]) + rng.random() * 0.01 for _ in range(rng.randrange(18))]
        assert [(a, z) for a, z, _ in toxicity.maximal_segments(np.array(s))] == split(s, 0, len(s))


def test_toxicity_on_held_out_rows(spark, documents_of, odd_rows):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(docs, model).where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(caught) / len(caught) > 0.85 and sum(clean) / len(clean) < 0.01
    odd = toxicity.score_documents(documents_of(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)
    assert toxicity.drop_toxic(documents_of(odd_rows), model).columns == documents_of([]).columns
    assert toxicity.score_documents(documents_of([]), model).collect() == []
    nothing = toxicity.fit(documents_of([]), labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score_documents(documents_of(odd_rows), nothing).collect())


def test_toxicity_is_fitted_on_all_segments(spark, documents_of, monkeypatch):
    clean, bad = "plain words of a calm text ", "vile scum "
    rows = [(k, clean * 3 + (bad if k % 2 else "")) for k in range(300)] + [(500 + k, (bad + clean * 9) * 300) for k in range(60)]
    labels = spark.createDataFrame([(d, d % 2 if d < 500 else 1) for d, _ in rows], "doc_id long, toxic int")
    fitted = []
    monkeypatch.setattr(toxicity, "fit_curve", lambda x, y, fit=toxicity.fit_curve: fitted.append((x, y)) or fit(x, y))
    model = toxicity.fit(documents_of(rows), labels)
    known = toxicity.WordScores(model)
    words = toxicity.WORD.findall(rows[-1][1])
    segments = [s for _, _, s in toxicity.maximal_segments(np.array([known[w] for w in words]))]
    assert len(segments) > 200
    expected = toxicity._features(model.gumbel, segments, len(words), toxicity._distinct(known, words))
    assert np.isclose(fitted[0][0], expected).all(axis=1).any()


# Language


def test_language_on_held_out_rows(spark, documents_of, odd_rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs)
    rows = langid.identify(docs, model).where("held_out").join(docs, "doc_id").select("lang_pred", "lang").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    odd = langid.identify(documents_of(odd_rows), model).collect()
    assert sorted(r.lang_pred == "und" for r in odd) == sorted(t is None or not any(map(str.isalpha, t)) for _, t in odd_rows)
    assert all(0 <= r.score <= 1 for r in odd)
    assert langid.identify(documents_of([]), model).collect() == []
    untaught = langid.fit(documents_of([]).selectExpr("doc_id", "text", "label AS lang"))
    assert {r.lang_pred for r in langid.identify(documents_of(odd_rows), untaught).collect()} == {"und"}


def test_long_and_rare_texts_leave_all_languages(documents_of):
    rows = [(k, "the cat and the dog went over the old bridge in the evening " * (1 + 200 * (k % 5 == 1))) for k in range(600)]
    rows += [(1000 + k, "der hund und die katze gingen abends durch den alten wald") for k in range(10)]
    rows += [(2000 + k, "el perro y el gato caminaban por la vieja calle " * 400) for k in range(10)]
    docs = documents_of(rows).selectExpr("doc_id", "text", "CASE WHEN doc_id < 1000 THEN 'en' WHEN doc_id < 2000 THEN 'de' ELSE 'es' END AS lang")
    assert langid.fit(docs, rows=30, chars=9000).languages == ["de", "en", "es"]
    assert langid.shares({"a": 2, "b": 1000, "c": 50}, 100) == {"a": 2, "c": 49, "b": 49}
