"""Classifiers, language model and pipeline on planted corpora."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reclattice.llm import attention, language, scoring, toxicity
from reclattice.llm.common import held_out

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def toxic(spark):
    draw = random.Random(1)
    neutral = [f"word{i}" for i in range(300)]
    bad = ["grublix", "snorfle", "vexatory"]
    rows, labels = [], []
    for i in range(600):
        words = [draw.choice(neutral) for _ in range(draw.randint(5, 60))]
        label = int(i % 5 == 0)
        if label:
            words[draw.randrange(len(words))] = draw.choice(bad) + draw.choice(["", "s", "ed"])
            # A group is named mostly in toxic texts, which must not make the name toxic.
            if draw.random() < 0.9:
                words.append("muslim")
        elif draw.random() < 0.02:
            words.append("muslim")
        rows.append((i, " ".join(words), "keep"))
        labels.append((i, label))
    rows += [(600, None, "keep"), (601, "", "keep"), (None, "grublix", "keep"), (602, "grublix " * 30_000, "keep")]
    labels += [(600, None), (3, labels[3][1]), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_words_and_not_names(toxic, spark):
    documents, labels = toxic
    model = toxicity.fit(toxicity.labelled(documents, labels, ~held_out("doc_id", 4, 2)))
    found = {r["doc_id"]: r for r in toxicity.score(documents.select("doc_id", "text"), model).collect()}
    for i in range(600):
        if remainder(i, 4) == 2:
            assert found[i]["predicted"] == int(i % 5 == 0)
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[602]["predicted"] == 1
    assert found[600]["score"] == found[601]["score"] < 0.3
    neutral = model.score("word1 word2 muslim")
    assert neutral < 0.3 and abs(neutral - model.score("word1 word2 christian")) < 0.1
    free = toxicity.fit(toxicity.labelled(documents, labels, F.lit(True)), toxicity.Settings(swap=0.0))
    assert free.score("word1 word2 muslim") - free.score("word1 word2 christian") > neutral - model.score("word1 word2 christian")
    kept = toxicity.reject(documents, model)
    assert kept.columns == documents.columns and 602 not in {r["doc_id"] for r in kept.collect()}
    nothing = toxicity.fit(toxicity.labelled(documents, labels.limit(0), F.lit(True)))
    assert nothing.score("grublix") < 0.3
    assert toxicity.score(documents.limit(0), model).count() == 0


def test_languages(spark):
    draw = random.Random(2)
    syllables = {"en": ["the", "ing", "and"], "de": ["ung", "sch", "für"], "fr": ["eau", "les", "qué"]}
    rows = []
    for i in range(300):
        lang = draw.choice(sorted(syllables))
        rows.append((i, " ".join("".join(draw.choice(syllables[lang]) for _ in range(3)) for _ in range(draw.randint(2, 40))), lang))
    rows += [(300, None, "en"), (301, "123 !!", "de"), (302, "", None), (303, "theingand", None), (None, "the and", "en"), (304, "ungsch " * 300_000, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(documents.filter(~held_out("doc_id", 5, 0)))
    found = {r["doc_id"]: r for r in language.predict(documents.select("doc_id", "text"), model).collect()}
    tested = [(i, lang) for i, _, lang in rows[:300] if remainder(i, 5) == 0]
    assert np.mean([found[i]["lang_pred"] == lang for i, lang in tested]) > 0.97
    assert [found[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3 and found[303]["lang_pred"] == "en" and found[304]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language.fit(documents.limit(0)).probabilities("the") is None
    pieces = language.grams("ab cd " * 400_000, 512)
    assert abs(pieces.sum() - language.grams("ab cd " * 4, 512).sum() * 100_000) < 300_000


def test_attention_gradients_and_probabilities():
    settings = attention.Settings(vocabulary=300, width=4, size=6, steps=5, batch=32)
    with open(RANKS, "rb") as file:
        ranks = scoring.parse_ranks(file.read())
    subwords = attention.Subwords(ranks, settings.vocabulary)
    words = [b"the", b"", b"onouwh", "é".encode(), b"the"]
    context, target, length = subwords.windows(words, settings.width)
    assert length.sum() == len(target) and (context[0] == subwords.start).all()
    assert list(target[:length[0]]) == subwords(b"the") and subwords(b"") == [subwords.end]
    model = attention.Model(settings, np.bincount(target, minlength=301))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.p["out"] += np.random.default_rng(0).standard_normal(model.p["out"].shape) * 0.1
    model.p["wide_b"] += 0.01  # away from the corner that fully masked windows sit on
    _, grads = model.gradients(context, target)
    for name, grad in grads.items():
        at = tuple(np.unravel_index(np.argmax(np.abs(grad)), grad.shape))
        value, step = model.p[name][at], 1e-5
        model.p[name][at] = value + step
        above, _ = model.gradients(context, target)
        model.p[name][at] = value - step
        below, _ = model.gradients(context, target)
        model.p[name][at] = value
        assert abs((above - below) / (2 * step) - grad[at]) < 1e-4 * max(1, abs(grad[at]))
    model._forget()
    logits, _ = model.forward(context)
    plain = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(model.log_probabilities(context, target), plain[np.arange(len(target)), target], atol=1e-5)


@pytest.mark.parametrize("head", [5, 300_000])
def test_scores_of_documents(spark, monkeypatch, head):
    monkeypatch.setattr(scoring, "HEAD", head)
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 30)))) for i in range(80)]
    rows += [(80, None), (81, "The THE the neverseen"), (None, "w1 w2"), (5, rows[5][1])]
    documents = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", held_out("doc_id", 5, 1))
    settings = scoring.Settings(spelling=attention.Settings(vocabulary=300, steps=20, batch=64))
    found = scoring.scores(documents, RANKS, settings).collect()
    counts = Counter()
    for i, text in rows:
        if i is not None and remainder(i, 5) != 1:
            counts.update(scoring.words_of(text))
    tokens = sum(counts.values())
    whole = tokens + 0.5 * (len(counts) + 1)
    expected = []
    for i, text in rows:
        words = scoring.words_of(text)
        expected.append((i, len(words), sum(w in counts for w in words), tokens, round(sum(math.log10((counts[w] + 0.5) / whole) for w in words), 6)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert all(r["score"] < 0 for r in found)
    assert scoring.scores(documents.limit(0), RANKS, settings).count() == 0


def test_scores_do_not_depend_on_the_head(spark, monkeypatch):
    draw = random.Random(17)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(60 * draw.random() ** 2)}" for _ in range(draw.randint(1, 40))), i % 5 == 1) for i in range(80)]
    rows += [(80, "a1 a2 neverseen", True), (81, None, True)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    settings = scoring.Settings(classes=2, prior=5.0, spelling=attention.Settings(vocabulary=300, steps=20, batch=64))
    found = []
    for head in (5, 300_000):
        monkeypatch.setattr(scoring, "HEAD", head)
        found.append({r["doc_id"]: r["score"] for r in scoring.scores(documents, RANKS, settings).collect()})
    assert found[0] == pytest.approx(found[1], abs=1e-4)


def test_probabilities_add_up_to_one_at_most(spark):
    draw = random.Random(18)
    unseen = {"".join(draw.choice("cdefgh") for _ in range(draw.randint(1, 8))) for _ in range(3000)}
    rows = [(i, "aa bb", False) for i in range(8)] + [(8 + i, text, True) for i, text in enumerate(["", "aa", "bb", *sorted(unseen)])]
    documents = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    settings = scoring.Settings(classes=2, spelling=attention.Settings(vocabulary=300, steps=20, batch=64))
    found = {r["doc_id"]: r["score"] for r in scoring.scores(documents, RANKS, settings).filter("held_out").collect()}
    # No two of these texts are equal, and each is scored to its end.
    assert len(found) == len(unseen) + 3 and 0.1 < sum(10 ** x for x in found.values()) <= 1


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "tokens"]
    at, size = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf).persist()
        if name != "tokens":
            assert at.columns == docs.columns
        assert at.count() <= size
        size = at.count()
        if name in ("near_duplicates", "decontamination"):
            assert all(texts[r["doc_id"]] == r["text"] for r in at.select("doc_id", "text").collect())
    rows = at.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in rows)
    clean = {r["doc_id"] for r in labels.filter("toxic = 0").collect()}
    assert len(clean) > 0 and size > 0


def test_token_stage_writes_no_texts(spark):
    """What lies between encoding and decoding holds a digest of the text, and the check still finds all."""
    rows = [(1, "en", "a", "Plain words, naïve ones"), (2, "en", "a", ""), (3, None, "b", None), (4, "xx", "b", "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    made = corpus_pipeline.token_stage(spark, docs, "")
    found = {r["doc_id"]: r for r in made.collect()}
    assert all(r["round_trip"] for r in found.values()) and found[2]["n_tokens"] == found[3]["n_tokens"] == 0
    names = set(spark.read.parquet(*made.inputFiles()).columns)
    assert names == {"doc_id", "lang", "source", "ids", "digest"}


def test_classes_are_learnt_from_all_documents(spark):
    """A sample of a few texts only starts them: words and shares come from every learning text."""
    draw = random.Random(23)
    sides = [[f"{side}{i}" for i in range(30)] for side in "ab"]
    rows = [(i, i < 8, " ".join(draw.choice(sides[i % 2][:10] if i < 8 else sides[i % 2]) for _ in range(20))) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, start boolean, text string")
    hashed = documents.mapInArrow(scoring.hashed_words, "doc_id long, start boolean, hash array<bigint>, n array<bigint>")
    classes = scoring.learn_classes(hashed, scoring.Settings(classes=2, marks=70))
    assert len(classes.marks) == 61 and (np.diff(classes.marks) > 0).all()
    assert np.allclose(np.exp(classes.weight), 0.5, atol=0.02)
    a, b = (classes.places(np.array([scoring.hash_of(w.encode()) for w in side])) for side in sides)
    assert (a >= 0).all() and (b >= 0).all()
    gap = classes.share[0] - classes.share[1]
    assert (np.sign(gap[a]) == np.sign(gap[a[0]])).all() and (np.sign(gap[b]) == -np.sign(gap[a[0]])).all()
    # Words that no sampled text holds are as frequent as the others.
    own = np.exp(classes.share[0 if gap[a[0]] > 0 else 1][a])
    assert own[10:].sum() > 1.5 * own[:10].sum()


def test_words_of_several_texts_are_weighed_at_once():
    texts = ["One two two".encode(), b"", "Été one  ".encode(), b"two " * 3]
    tokens = scoring.Tokens(texts)
    words = tokens.bytes_of(np.arange(len(tokens.key)))
    found = [dict() for _ in texts]
    for text, word, times in zip(tokens.text, tokens.word, tokens.times):
        found[text][words[word]] = times
    assert found == [dict(Counter(scoring.words_of(t.decode()))) for t in texts] and tokens.size.tolist() == [4, 1, 3, 4]
    memo = scoring.Memo(np.int64)
    memo.add(tokens.key, np.arange(len(tokens.key)))
    assert not len(memo.missing(tokens.key, 100)) and memo.values(tokens.key)[0].tolist() == list(range(len(words)))
    # What is marked stays when the memo is full.
    more = np.array([2, 4], np.uint64)
    memo.missing(more, len(words), lambda columns: columns[0] == 1)
    assert memo.missing(tokens.key, 100).tolist() == [i for i in range(len(words)) if i != 1]


def test_classes_start_from_all_documents(spark):
    """No document marked for the sample, or only those of one side: the sides are told apart all the same."""
    draw = random.Random(24)
    sides = [[f"{side}{i}" for i in range(20)] for side in "abc"]
    rows = [(i, " ".join(draw.choice(sides[i % 3]) for _ in range(20))) for i in range(300)]
    found = []
    for start in ("false", "doc_id = 0", "doc_id % 3 = 0"):
        documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", f"{start} as start", "text")
        for parts in (1, 5):
            hashed = documents.repartition(parts).mapInArrow(scoring.hashed_words, "doc_id long, start boolean, hash array<bigint>, n array<bigint>")
            classes = scoring.learn_classes(hashed, scoring.Settings(classes=3, marks=70))
            found.append((classes.weight, classes.share))
            assert np.allclose(np.exp(classes.weight), 1 / 3, atol=0.02)
            own = [np.exp(classes.share[:, classes.places(np.array([scoring.hash_of(w.encode()) for w in side]))]).sum(axis=1) for side in sides]
            assert sorted(np.argmax(own, axis=1)) == [0, 1, 2] and (np.max(own, axis=1) > 0.8).all()
    # Neither the sample nor the order and the partitions of the rows matter.
    assert all(np.allclose(f[i], found[0][i], atol=1e-5) for f in found for i in (0, 1))


def test_marker_words_come_back_from_their_bytes(monkeypatch):
    draw = np.random.default_rng(25)
    row = np.sort(draw.integers(1, 9, 50))
    one = scoring.Marked(draw.integers(-(1 << 62), 1 << 62, 11), row, draw.integers(0, 70_000, 50), draw.integers(1, 300, 50))
    same = scoring.Marked.unpacked(**one.packed())
    assert all((getattr(one, k) == getattr(same, k)).all() for k in ("key", "row", "place", "n"))
    table, soft = draw.normal(size=(70_000, 3)), draw.normal(size=(11, 3))
    dense = np.zeros((11, 70_000))
    np.add.at(dense, (row, one.place), one.n)
    assert np.allclose(same.against(table), dense @ table) and np.allclose(same.mass(soft, 70_000), dense.T @ soft)
    # In matrices of a few documents at a time as in column sums.
    few = scoring.Marked(one.key, row, one.place % 9, one.n)
    dense, wide = np.zeros((11, 9)), draw.normal(size=(9, 20))
    np.add.at(dense, (row, few.place), 1)
    first = np.unique(row * 9 + few.place, return_index=True)[1]
    few = scoring.Marked(one.key, row[first], few.place[first], dense[row[first], few.place[first]])
    monkeypatch.setattr(scoring, "PLACES", 25)
    assert few._multiplied(20, 9) and np.allclose(few.against(wide), dense @ wide)
    assert np.allclose(few.mass(dense @ wide, 9), dense.T @ dense @ wide)
    assert np.allclose(np.bincount(row, weights=same.unit() ** 2, minlength=11), np.bincount(row, minlength=11) > 0)
