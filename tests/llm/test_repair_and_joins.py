"""Conversation repair, spelling variants, the Jaccard join and the classifiers against their plain versions."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swaymeter.llm import conversations, jaccard, langid, quality_model, simhash, spelling, toxicity
from swaymeter.llm.queries import QUERIES
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# conversations

ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=14)


@settings(max_examples=1500, deadline=None)
@given(ROWS)
def test_cheapest_edits(chat):
    assert conversations.cheapest(chat) == plain.cheapest(chat)


@settings(max_examples=150, deadline=None)
@given(ROWS, st.integers(1, 5))
def test_cheapest_edits_in_pieces(chat, size):
    found = conversations.ways
    pieces, keep = conversations.SEGMENT, chat
    try:
        conversations.SEGMENT = size
        assert min(found(keep)[0, e] for e in (0, 3) if (0, e) in found(keep)) == plain.cheapest(keep)
        assert conversations.plan(keep) == plain.cheapest(keep)
    finally:
        conversations.SEGMENT = pieces


def odd_chats():
    rng = random.Random(3)
    said = ["Yes.", "No!", "Why?", "so", "", " \n", None, "é…", "a.\t", "Yes.", "x" * 200_000 + "."]
    out = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            at = rng.choice([turn, turn, turn, turn + 3, None, 0])
            out.append((conv, at, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(said)))
    return out + out[:5]


CHAT = "conv_id long, turn long, role string, text string"


def expected(chats):
    return sorted(((conv, *plain.conversation(kept)) for conv, kept in plain.damage(chats).items()), key=repr)


@pytest.mark.parametrize("long", [4096, 6, 0])
def test_conversation_repair(spark, monkeypatch, long):
    """As they are, and with conversations of more than 6 or 0 rows taken as long ones."""
    monkeypatch.setattr(conversations, "LONG_ROWS", long)
    monkeypatch.setattr(conversations, "SEGMENT", 3)
    chats = odd_chats()
    frame = spark.createDataFrame(chats, CHAT).selectExpr("*", "1 AS gone", "2 AS fault", "'x' AS audit", "3 AS `odd.name`")
    assert rows(conversations.op11_conversation_repair(frame)) == expected(chats)
    assert conversations.op11_conversation_repair(frame.limit(0)).count() == 0


def test_one_conversation_of_all_rows(spark, monkeypatch):
    """A long conversation of equal turns and many equal rows is shared out."""
    monkeypatch.setattr(conversations, "LONG_ROWS", 100)
    rng = random.Random(8)
    chats = [(7, t // 3 if t % 2 else None, rng.choice(["user", "assistant"]), rng.choice(["Hm.", "Well", f"No {t}."])) for t in range(600)]
    assert rows(conversations.op11_conversation_repair(spark.createDataFrame(chats, CHAT))) == expected(chats)


def test_conversations_of_the_tables(spark):
    chats = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(QUERIES["op11_conversation_repair"](spark, SF)) == expected(chats)


# spelling

WORDS = st.lists(st.text(alphabet="abcé", min_size=6, max_size=9), min_size=1, max_size=60, unique=True)


@settings(max_examples=200, deadline=None)
@given(WORDS, st.integers(1, 4))
def test_near_words_of_a_cell(words, leaf):
    keep, spelling.LEAF = spelling.LEAF, leaf
    try:
        by_length = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for asked in by_length.values():
            for there in by_length.values():
                if abs(len(asked[0]) - len(there[0])) <= 1:
                    i, j = spelling.near(spelling.letters(asked), spelling.letters(there))
                    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [
                        (x, y) for x, a in enumerate(asked) for y, b in enumerate(there) if plain.one_edit(a, b)]
    finally:
        spelling.LEAF = keep


def odd_texts():
    rng = random.Random(4)
    stems = ["harbour", "colour", "naïveté", "ÀÉÎõü×÷", "z" * 300, "committee"]
    texts = []
    for i in range(300):
        some = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "e", w[at] * 2]) + w[at + 1 :]
            some.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        texts.append((i % 250 if i % 9 else None, " ".join(some) + rng.choice([".", "1a", "\n日本"])))
    return [*texts, (1, None), (2, ""), (3, "word"), (4, "unusual " * 40_000), texts[0], texts[0]]


@pytest.mark.parametrize("cell", [8192, 3])
def test_spelling(spark, monkeypatch, cell):
    """With one cell a length, and with many."""
    monkeypatch.setattr(spelling, "CELL", cell)
    texts = odd_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "'x' AS form", "3 AS `odd.name`")
    assert rows(spelling.op12_spelling(docs)) == sorted(plain.spelling(texts), key=repr)
    assert spelling.op12_spelling(docs.limit(0)).count() == 0


def test_spelling_of_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op12_spelling"](spark, SF)) == sorted(plain.spelling(docs), key=repr)


# the Jaccard join


def similar_texts():
    rng = random.Random(6)
    out = []
    for family in range(30):
        text = [rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(40)) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(1, 9)):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.randint(0, 1)] = rng.choice([[], ["new"], ["New", "words"]])
            if rng.random() < 0.1:
                text = text[: max(1, len(text) * 3 // 4)]
    passage = " ".join(f"p{i}" for i in range(60))
    out += [f"{passage} {' '.join(f'{k}x{i}' for i in range(rng.choice([5, 10, 14, 20, 40])))}" for k in range(40)]
    out += [None, "", " \n", "one", "ONE", "one two three four", "one two three four five", "word " * 30_000, "Word " * 9, out[0], out[0]]
    return [(i if i % 7 else None, t) for i, t in enumerate(out)] + [(3, out[3]), (3, out[3])]


@pytest.mark.parametrize("held", [1 << 20, 40])
def test_jaccard(spark, monkeypatch, held):
    """With whole groups, and with groups and those that ask them shared out."""
    monkeypatch.setattr(jaccard, "MEMBERS", 2 if held == 40 else 256)
    monkeypatch.setattr(jaccard, "HELD_TOKENS", held)
    monkeypatch.setattr(jaccard, "HELD_ASKED", 3 if held == 40 else 4096)
    texts = similar_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS sid", "2 AS n", "'x' AS g", "3 AS `odd.name`").repartition(5)
    assert rows(jaccard.op13_jaccard(docs)) == plain.jaccard(texts)
    assert jaccard.op13_jaccard(docs.limit(0)).count() == 0


def test_jaccard_without_first_groups(spark, monkeypatch):
    """The matrix alone finds all links: groups of one set each, and every token counted as hot."""
    empty = lambda self, members, asked: real(self, members.limit(0), asked)
    real, calls = jaccard._Sets.links, []

    def links(self, members, asked):
        calls.append(1)
        return empty(self, members, asked) if len(calls) == 1 else real(self, members, asked)

    order = jaccard._order
    monkeypatch.setattr(jaccard._Sets, "links", links)
    monkeypatch.setattr(jaccard, "_order", lambda profile: (order(profile)[0], 0))
    texts = similar_texts()
    assert rows(jaccard.op13_jaccard(spark.createDataFrame(texts, "doc_id long, text string"))) == plain.jaccard(texts)


def test_jaccard_near_copies_meet_few_groups(spark, monkeypatch):
    """Near copies of one text, many too far from it to be linked: each asks a group for each of the keys at most, and not one for
    every MEMBERS copies."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(90)]
    copy = lambda edits: " ".join("".join(rng.choices("abcdefgh", k=9)) if i in edits else w for i, w in enumerate(base))
    texts = [(i, copy(set(rng.sample(range(90), rng.randint(1, 5))))) for i in range(400)]
    real, asked_rows = jaccard._Sets.links, []

    def links(self, members, asked):
        asked_rows.append(asked.count())
        return real(self, members, asked)

    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    monkeypatch.setattr(jaccard._Sets, "links", links)
    assert rows(jaccard.op13_jaccard(spark.createDataFrame(texts, "doc_id long, text string"))) == plain.jaccard(texts)
    assert asked_rows[1] <= jaccard.KEYS * len(texts)


def test_jaccard_opens_only_for_sets_that_can_be_linked(spark, monkeypatch):
    """Families that share most of a passage but are not linked meet in the matrix; their signatures tell them apart, and no tokens
    are fetched for them."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(81)]
    texts = []
    for _ in range(30):
        own = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(19)]
        texts += [" ".join(passage + own[: 19 - k]) for k in range(3)]
    texts = list(enumerate(texts))
    real, fetched = jaccard._Sets.tokens, []

    def tokens(self, wanted):
        fetched.append(wanted.count())
        return real(self, wanted)

    monkeypatch.setattr(jaccard._Sets, "tokens", tokens)
    assert rows(jaccard.op13_jaccard(spark.createDataFrame(texts, "doc_id long, text string"))) == plain.jaccard(texts)
    assert fetched[1] < len(texts) // 3


def test_jaccard_sifts_no_link(spark):
    """Sets and members that are linked stay, at any width of the signatures and however groups are shared out."""
    rng = random.Random(8)
    sides = []
    for k in range(120):
        n = rng.choice([3, 63, 64, 66, 127, 130, 1000])
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.sort(a[: max(1, (9 * len(a) + 9) // 10)]) if k % 3 else np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        sides.append((k, a, b))
    group = jaccard._Signed(7)
    for k, a, _ in sides:
        group.add(k, k, len(a), jaccard.signature(a))
    for _, _, b in sides:
        linked = [i for i, a, _ in sides if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))]
        assert group.asks(-1, len(b), jaccard.signature(b)) >= bool(linked)
        assert {(7, False, i) for i in linked} <= set(group.met())


def test_jaccard_leaves_no_shuffle_files(spark):
    """The shuffle files of a step go when it ends, not when the driver collects its garbage, and the tokens fetched go too."""
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(name, None), files()
    jaccard.op13_jaccard(spark.createDataFrame(list(enumerate(t for _, t in similar_texts())), "doc_id long, text string"))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.5)
    assert not files() - before
    assert spark.conf.get(name, None) == was


def test_jaccard_of_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op13_jaccard"](spark, SF)) == plain.jaccard(docs)


# toxicity

SAID = ["you", "idiot", "scum", "not", "said", "will", "kill", "they", "kind", ",", ".", "!", "\n", '"', "“", "”", "(", "ihr", "nie", "nobody's"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(SAID), max_size=30))
def test_clauses_against_a_plain_walk(words):
    text, weights = " ".join(words), {"idiot": 5.0, "scum": 2.0}
    totals = plain.clause_totals(text, weights)
    found = toxicity.features(text, toxicity.Lexicon({"idiot$": 5.0, "scum$": 2.0}))
    if any(w in words for w in ("idiot", "scum", "kill")):
        assert found[0] == pytest.approx(max(totals, default=0.0)) and found[2] == pytest.approx(math.log1p(len(totals)))
        assert found[1] == pytest.approx(math.log1p(sum(totals)))


def test_reported_speech_passes_marks():
    best = lambda text: toxicity.features(text, toxicity.Lexicon({"idiot$": 5.0}))[0]
    assert best("she said idiot") == best("she said: idiot") == best('she said, "idiot"') == 3.75
    assert best("she said: “well. idiot”") == 2.5 and best("she said: “well”. idiot") == 5
    assert best('she said "well" to an idiot') == 7.5 and best("if they come they will, he said, kill you") > 0
    assert best("idiot") == 5 and best("not, an idiot") == 1.5


def test_sample_is_bounded_by_rows(spark):
    """One id with thousands of different texts gives no more rows than the bound."""
    docs = spark.createDataFrame([(7, " ".join("abcdefghij"[int(d)] * 3 for d in str(10_000 + i))) for i in range(3000)] + [(8, "clean words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (7, 1)], "doc_id long, label int")
    sample = toxicity._sample(docs, labels, 10)
    assert sorted(r["count"] for r in sample.groupBy("label").count().collect()) == [1, 10]


def test_keep_one_marks_each_text_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    real = simhash._Append

    def counted(at):
        def run(batches):
            for batch in real(at)(batches):
                calls.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(simhash, "_Append", counted)
    docs = spark.createDataFrame([(i, f"word{i % 5} " * 60, "x") for i in range(40)] + [(None, "one", "y"), (3, None, "z")], "doc_id long, text string, `odd.name` string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["text"] and "word" in r["text"]) == [0, 1, 2, 3, 4]
    assert calls.value == 42


# language and quality


def test_language_scores_against_plain_vectors(spark):
    """Document frequencies over all training rows, and the cosine with each centroid, from dictionaries of n-grams."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows_ = [r.asDict() for r in docs.collect()]
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows_}
    grams = {r["doc_id"]: plain.language_grams(r["text"], langid.ORDERS, langid.STEP, langid.MIX, langid.FEATURES) for r in rows_}
    train = [r for r in rows_ if not held[r["doc_id"]] and r["lang"] is not None]
    df = Counter(g for r in train for g in grams[r["doc_id"]])
    idf = {g: math.log((1 + len(train)) / (1 + n)) + 1 for g, n in df.items()}
    model = langid.fit(docs.where(F.col("doc_id").isin([r["doc_id"] for r in train])))
    assert all(model.idf[g] == pytest.approx(v) for g, v in idf.items())
    got = {r["doc_id"]: r for r in langid.op7_language_id(docs).collect()}
    for r in rows_[:40]:
        own = {g: math.log1p(n) * idf.get(g, math.log(1 + len(train)) + 1) for g, n in grams[r["doc_id"]].items()}
        size = math.sqrt(sum(v * v for v in own.values())) or 1.0
        cosines = [sum(v * float(centre[g]) for g, v in own.items()) / size for centre in model.centres]
        found = got[r["doc_id"]]
        assert found["score"] == pytest.approx(max(cosines), abs=1e-4) and found["held_out"] == held[r["doc_id"]]
        near = {lang for lang, c in zip(model.langs, cosines, strict=True) if c > max(cosines) - 1e-5}
        assert found["lang_pred"] in near


def test_quality_scores_against_plain_densities(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x = {r["doc_id"]: quality_model.statistics(r["text"]) for r in docs.select("doc_id", "text").collect()}
    train = [(r["quality"], x[r["doc_id"]]) for r in labels.collect()
             if r["quality"] is not None and r["doc_id"] in x and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    ids = sorted(x)
    want = plain.gaussian_scores(train, [x[i] for i in ids], quality_model.POOLED, quality_model.DIAGONAL, quality_model.FLOOR, quality_model.TEMPERATURE)
    got = {r["doc_id"]: r["score"] for r in quality_model.op8_quality_classifier(docs, labels).collect()}
    for i, score in zip(ids, want, strict=True):
        assert got[i] == pytest.approx(score, abs=1e-9)
