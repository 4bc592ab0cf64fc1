"""Personal data: patterns, and the words around them that give them away.

All of it is DataFrame functions.  Emails, IP addresses, card and phone numbers are found by pattern; each is a protected
entity.  A word of a document reveals the document's entities as far as the corpus ties the two together: the
pointwise mutual information of word and entity as a share of the entity's information content, over whole
documents.  Counts are smoothed: an entity's prior is the rate of its group (an email's domain, else its kind), the
group's is the word's rate in the corpus, so that an entity of one document gets an estimate too.  From a first share
on a revealing word is generalised, from a second on it is removed.

Rarity alone is no disclosure: in a large corpus any rare word beside an entity has a high share.  So a word counts only
if chance would hardly do the same.  With b the documents that both share, words as rare or rarer than this one would
meet that entity in b documents or more about (u / N) ** b / b! * sum(f ** b) times, summed over those words' document
frequencies f, where u is the entity's documents, each weighed by its number of distinct words against the mean.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.base import buckets_for, query, table, written

KINDS = ("email", "ip", "card", "phone")
#: Java patterns of the kinds.  Possessive repeats and a start that is either a run's first character or the end of
#: the match before keep them linear; they match what the plain patterns do.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole run of digits with single separators; runs of other sizes could not pass.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}{3,}"
PRIOR = 1.0  # documents that a prior counts as
GENERALISE, REMOVE = 0.6, 0.9
BY_CHANCE = 0.05  # words that chance may tie to an entity
CROWDED, BUCKET = 32, 8_000_000  # document frequencies that many terms have, and bytes of terms in a bucket
MEETINGS = 4  # shared documents that are told apart; more count as four
REPLACEMENTS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[WORD]", "remove": ""}

MATCH = "array<struct<start:bigint,end:bigint,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Matches with their character positions."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(MATCH).alias("out"))

    def place(both: Column) -> Column:
        values, pieces = both["values"], both["pieces"]

        def step(state: Column, k: Column) -> Column:
            value = F.get(values, k)
            first = state["at"] + F.char_length(F.get(pieces, k))
            last = first + F.char_length(value)
            found = F.struct(first.alias("start"), last.alias("end"), value.alias("value"))
            return F.struct(last.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), start, step, lambda s: s["out"])

    # Bound by an array of one, as the steps would otherwise search the text again for every match.
    both = F.array(F.struct(values.alias("values"), F.split(text, pattern, -1).alias("pieces")))
    found = F.get(F.transform(both, place), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(MATCH))


def each(kind: str, build) -> Column:
    """``build(match, kind)`` for every match of a kind's column."""
    return F.transform(F.col(kind), lambda m: build(m, kind))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(value: Column) -> Column:
    number = digits(value)
    size = F.char_length(number)

    def add(total: Column, k: Column) -> Column:
        digit = number.substr(size - k + 1, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(k % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
        return F.forall(F.split(value, r"\."), lambda p: part(F.concat(F.lit("0"), F.ltrim(p, F.lit("0")))))
    if kind == "card":
        return F.char_length(digits(value)).between(16, 19) & passes_luhn(value)
    if kind == "phone":
        return F.char_length(digits(value)).between(8, 15)
    return F.lit(True)


def base_matches(text: Column, kind: str) -> Column:
    """Valid matches of one kind, leftmost and without overlap; what fails is dropped and not tried again."""
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    hint = HINTS[kind]
    return found if hint is None else F.when(F.contains(text, F.lit(hint)), found).otherwise(F.array().cast(MATCH))


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind in ("email", "ip") else digits(value)
    return F.xxhash64(F.lit(kind), plain)


def _group(kind: str, value: Column) -> Column:
    """What rare entities are counted together by: the domain of an email, else the kind."""
    return F.xxhash64(F.lit("group"), F.lit(kind), F.lower(F.substring_index(value, "@", -1)) if kind == "email" else F.lit(""))


def words_of(text: Column) -> Column:
    """The distinct words of a whole text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def find_base(documents: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``uid`` (of id and text), the spans of each kind, and the ``text`` where there are any."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    uid = F.xxhash64("doc_id", "text").alias("uid")
    found = docs.select("doc_id", uid, "text", *[base_matches(F.col("text"), k).alias(k) for k in KINDS])
    place = lambda m, kind: F.struct(m["start"].alias("start"), m["end"].alias("end"),
                                     _entity(kind, m["value"]).alias("entity"), _group(kind, m["value"]).alias("group"))
    some = F.concat(*[F.transform(k, lambda m: m["start"]) for k in KINDS])
    found = found.select("doc_id", "uid", *[each(k, place).alias(k) for k in KINDS], F.when(F.size(some) > 0, F.col("text")).alias("text"))
    return found


def disclosure(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(``entity``, ``term``) -> ``share``: mutual information as a share of the entity's information content.

    All counts are of documents (rows), whole, over the whole corpus; terms are those of documents with the entity.
    Terms that chance would tie to the entity as well are left out.
    """
    total = F.lit(documents.count())
    terms = documents.select(F.explode(words_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("saying"))
    terms = written(terms, "terms")
    # Sums over all terms up to a document frequency; there are few frequencies, about the root of the corpus's words.
    tiers = terms.groupBy("saying").agg(F.count("*").cast("double").alias("terms"))
    upto = Window.orderBy("saying").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    powers = [F.sum(F.col("terms") * F.pow(F.col("saying").cast("double"), F.lit(b))).over(upto).alias(f"m{b}") for b in range(1, MEETINGS + 1)]
    # Most terms have the smallest frequencies, so these meet their sums in as many tasks as there are buckets.
    buckets = buckets_for(terms, BUCKET)
    rare = F.col("saying") <= CROWDED
    dealt = F.when(rare, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))
    tiers_dealt = tiers.select("saying", *powers).withColumn("bucket", F.explode(dealt))
    bucket = F.when(rare, F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).otherwise(0)
    terms = terms.withColumn("bucket", bucket).join(tiers_dealt, ["saying", "bucket"]).drop("bucket")
    said = F.lit(tiers.agg(F.sum(F.col("terms") * F.col("saying"))).first()[0] or 0.0)
    every = F.concat(*[each(k, lambda m, _: F.struct(m["entity"].alias("entity"), m["group"].alias("group"))) for k in KINDS])
    held = found.where(F.col("text").isNotNull()).select("text", F.array_distinct(every).alias("held"))
    held = written(held.select("held", words_of(F.col("text")).alias("words")), "entity-words")

    def counted(name: str) -> tuple[DataFrame, DataFrame]:
        """Documents of each key, and of each key and term."""
        keys = held.select("words", F.explode(F.array_distinct(F.transform("held", lambda h: h[name]))).alias(name))
        both = keys.select(name, F.explode("words").alias("term")).groupBy(name, "term").agg(F.count("*").alias(f"{name}_both"))
        return keys.groupBy(name).agg(F.count("*").alias(f"{name}_holding"), F.sum(F.size("words").cast("double")).alias(f"{name}_words")), both

    (entities, pairs), (groups, grouped) = counted("entity"), counted("group")
    of = held.select(F.explode("held").alias("h")).select("h.entity", "h.group").distinct()
    pairs = pairs.join(of.join(entities, "entity").join(groups, "group"), "entity")
    joined = pairs.join(grouped, ["group", "term"]).join(terms, "term")
    rate = F.col("saying") / total
    smooth = lambda name, prior: (F.col(f"{name}_both") + PRIOR * prior) / (F.col(f"{name}_holding") + PRIOR)
    mutual = F.log(smooth("entity", smooth("group", rate)) / rate)
    content = F.log(total / F.col("entity_holding"))
    # The entity's documents, weighed by length, are entity_words / (said / total) of total: the total cancels out.
    part = F.col("entity_words") / said
    chance = F.lit(None).cast("double")
    for b in range(MEETINGS, 0, -1):
        tied = F.pow(part, F.lit(b)) / math.factorial(b) * F.col(f"m{b}")
        chance = F.when(F.col("entity_both") >= b, tied) if b == MEETINGS else chance.when(F.col("entity_both") >= b, tied)
    joined = joined.where(chance <= BY_CHANCE)
    return joined.select("entity", "term", F.when(content > 0, mutual / content).otherwise(0.0).alias("share"))


def find_personal_data(documents: DataFrame) -> DataFrame:
    """Spans of every whole text: per row ``doc_id``, ``uid``, an array for each base kind, and ``terms``.

    Base spans have ``start``, ``end`` (characters, end exclusive) and ``entity``; ``terms`` are the revealing words
    of the text, wherever they stand, with ``action`` (generalise or remove).  Words are only marked in documents that
    hold the entity, never inside a base span.  Null texts are empty; null and repeated ids pass through.
    """
    found = written(find_base(documents), "personal-data")
    strong = disclosure(documents, found).where(F.col("share") >= GENERALISE)
    holders = found.where(F.col("text").isNotNull()).dropDuplicates(["uid"])
    every = F.array_distinct(F.concat(*[each(k, lambda m, _: m["entity"]) for k in KINDS]))
    # The pairs of a document meet the strong ones of its entities.
    said = holders.select("uid", F.explode(every).alias("entity"), "text").select("uid", "entity", F.explode(words_of(F.col("text"))).alias("term"))
    action = F.when(F.max("share") >= REMOVE, "remove").otherwise("generalise")
    marked = written(said.join(strong, ["entity", "term"]).groupBy("uid", "term").agg(action.alias("action")), "revealing-words")
    # A word ends after all words and gaps up to it; sums over a document's rows stay linear in its length.
    values, gaps = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    words = holders.join(marked.select("uid").distinct(), "uid", "left_semi").select("uid", F.posexplode(F.arrays_zip(values.alias("value"), gaps.alias("gap"))).alias("at", "w"))
    size = F.char_length("w.value")
    end = F.sum(F.char_length("w.gap") + size).over(Window.partitionBy("uid").orderBy("at")).alias("end")
    words = words.where(F.col("w.value").isNotNull()).select("uid", F.lower("w.value").alias("term"), size.alias("size"), end)
    placed = words.join(marked, ["uid", "term"]).select("uid", F.struct((F.col("end") - F.col("size")).alias("start"), "end", "action").alias("t"))
    revealed = placed.groupBy("uid").agg(F.sort_array(F.collect_list("t")).alias("terms"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,action:string>>")
    spans = F.concat(*[each(k, lambda m, _: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for k in KINDS])
    free = lambda t: ~F.exists(spans, lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"]))
    return found.join(revealed, "uid", "left").select("doc_id", "uid", *KINDS, F.filter(F.coalesce("terms", none), free).alias("terms"))


def sanitise(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with base spans replaced by their kind and revealing words generalised or removed."""
    found = find_personal_data(documents).drop("doc_id").dropDuplicates(["uid"])
    docs = documents.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("uid"))
    kinds = [each(k, lambda m, kind: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(REPLACEMENTS[kind]).alias("by"))) for k in KINDS]
    terms = F.transform("terms", lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"),
        F.when(t["action"] == "remove", REPLACEMENTS["remove"]).otherwise(REPLACEMENTS["generalise"]).alias("by")))
    text = F.col("text")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        # Of overlapping spans the first is replaced; the rest of a later one is dropped.
        piece = F.concat(text.substr((state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), s["by"])
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], piece)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text)))
    spans = F.array_sort(F.concat(*kinds, terms))
    return docs.join(found, "uid", "left").select("doc_id", F.aggregate(spans, begin, step, rest).alias("text"))


def listed(spans: Column, kind: str) -> Column:
    """kind:start:end of every span."""
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


@query("op10_personal_data")
def personal_data_query(spark, folder: str) -> DataFrame:
    found = find_personal_data(table(spark, folder, "documents"))
    base = F.concat(*[listed(F.col(k), k) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed(F.col("terms"), "term")), ",").alias("spans"),
    )
