"""Sketches, near-duplicates, repeated passages, embeddings and components."""

import random
from fractions import Fraction

import numpy as np
import pytest

from reclattice.llm import covertree, embeddings, neardup, similar, sketches, substrings
from reclattice.llm.common import written
from reclattice.llm.components import connected_components


def closure(nodes, links):
    part = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(part[a], part[b])
            if part[a] != low or part[b] != low:
                part[a] = part[b] = low
                changed = True
    return part


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if len(words) >= width else {tuple(words)}


def test_fast_similarity_estimates_jaccard():
    draw = np.random.default_rng(1)
    sketch = sketches.FastSimilarity(128)
    for size in (1, 2, 7, 60, 5000):
        errors = []
        for _ in range(20):
            both = draw.integers(0, 1 << 63, 3 * size).astype(np.uint64)
            a, b = both[:2 * size], both[size:]
            one, two = sketch(a), sketch(b)
            assert one.max() != sketches.EMPTY
            errors.append((one == two).mean() - size / (3 * size))
        assert abs(np.mean(errors)) < 0.05
    # More rounds than a set needs leave its sketch alone, so order and batching do not matter.
    a = draw.integers(0, 1 << 63, 300).astype(np.uint64)
    assert (sketch(a) == sketch(a[::-1])).all()


def test_bands_are_tuned_to_the_recall():
    bands, rows = sketches.tune_bands(0.8, 1e-4, 48)
    assert bands * rows <= 48 and sketches.miss_probability(0.8, bands, rows) <= 1e-4
    assert sketches.miss_probability(0.8, 48 // (rows + 1), rows + 1) > 1e-4


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    part = closure({n for link in links for n in link}, links)
    assert all(part[n] == c for n, c in found.items())
    assert {n for a, b in links if a != b for n in (a, b)} == set(found)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus(seed, groups=12, copies=9):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(1, 90))]
        for _ in range(copies):
            words = list(base)
            for _ in range(draw.randint(0, 4)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append(draw.choice([" ", "\n"]).join(words))
    return rows


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    texts = [*corpus(1), None, "", "one two", "One TWO", "one two three four"]
    rows = [(10 + i, t, "x") for i, t in enumerate(texts)] + [(12, texts[40], "x"), (None, texts[0], "x"), (None, texts[0], "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n string")
    sets = [(i, shingles(t, 4)) for i, t, _ in rows]
    links = [
        (a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x]
        if a is not None and b is not None and s and 100 * len(s & t) >= 80 * len(s | t)
    ]
    part = closure({i for i, _, _ in rows if i is not None}, links)
    found = neardup.near_duplicates(documents, neardup.FOUR_WORDS).collect()
    expected = [(i, len(s), part.get(i), i is None or part[i] == i) for i, s in sets]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    kept = neardup.one_of_each(documents, neardup.FOUR_WORDS)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i in part if part[i] == i)
    assert neardup.near_duplicates(documents.limit(0)).count() == 0


def test_texts_that_share_an_id_keep_their_links(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    near = {k: t.rsplit(" ", 1)[0] + " changed" for k, t in texts.items()}
    # Sets of one size and one least id; each is near a text of another id.
    rows = [(1, texts["a"]), (1, texts["b"]), (1, texts["c"]), (2, near["a"]), (3, near["b"]), (4, near["c"]), (5, texts["d"])]
    rows += [(1, near["c"]), (5, texts["d"])]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    kept = [(r["doc_id"], r["text"][0]) for r in neardup.one_of_each(documents).collect()]
    assert sorted(kept) == [(1, "a"), (1, "b"), (1, "c"), (5, "d")]


def test_links_beyond_the_pivot_are_found(spark):
    # A chain in which each text is near its neighbours only: pivots alone cannot join it.
    words = [f"v{i}" for i in range(120)]
    texts = [" ".join(words[5 * k:5 * k + 60]) for k in range(12)]
    sets = [shingles(t, 5) for t in texts]
    links = [(a, b) for a in range(12) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    part = closure(range(12), links)
    units = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    settings = similar.Settings(sketch=sketches.MinHash, bands=64, rows=1, width=5, similarity=Fraction(4, 5))
    assert {r["id"]: r["component"] for r in similar.clusters(units, settings).collect()} == part


def test_repeated_passages_are_found_and_clean_texts_left_alone(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(55))
    near = passage.split()
    near[30] = "changed"
    rows = []
    for i in range(30):
        own = [" ".join(word() for _ in range(40)) for _ in range(3)]
        if i < 6:
            own[1] = own[1] + " " + passage + " " + word()
        elif i in (10, 11):
            own[1] = passage if i == 10 else " ".join(near)
        rows.append((i, "\n".join(own), "k"))
    rows += [(30, None, "k"), (31, "", "k"), (None, rows[20][1], "k"), (32, "| | | | | | | | | |\n" * 20, "k")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    found = substrings.repeats(documents)
    hit = {r["doc_id"] for r in found.collect()}
    assert hit == {None, 20, *range(6), 10, 11}
    near_rows = {r["doc_id"] for r in found.filter("kind = 'paragraph' and doc_id in (10, 11)").collect()}
    assert near_rows == {10, 11}
    for r in found.filter("doc_id is not null").collect():
        text = rows[r["doc_id"]][1]
        assert len(text[r["start"]:r["end"]].split()) == r["words"]
    clean = {r["doc_id"]: r["text"] for r in substrings.without_repeats(documents, found).collect()}
    assert len(clean) == len({r[0] for r in rows}) and clean[15] == rows[15][1] and len(clean[5]) < len(rows[5][1])
    assert substrings.repeats(documents.limit(0)).count() == 0


def test_short_lines_are_paragraphs(spark):
    draw = random.Random(14)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    lines = {n: " ".join(word() for _ in range(n)) for n in (4, 5, 9, 14, 19)}
    near = lines[19].split()
    near[-1] = "changed"
    rows = []
    for n, line in lines.items():
        for other in (line, " ".join(near) if n == 19 else line):
            rows.append((len(rows), "\n".join([" ".join(word() for _ in range(30)), other, " ".join(word() for _ in range(30))])))
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).filter("kind = 'paragraph'").collect()
    assert sorted((r["doc_id"], r["words"], r["removed"]) for r in found) == [
        (2, 5, False), (3, 5, True), (4, 9, False), (5, 9, True), (6, 14, False), (7, 14, True), (8, 19, False), (9, 19, True),
    ]


@pytest.mark.parametrize("side", [16, 2])
def test_passages_reach_as_far_as_texts_agree(spark, monkeypatch, side):
    # With a short SIDE, ends are found on the joined texts.
    monkeypatch.setattr(substrings, "SIDE", side)
    draw = random.Random(15)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    rows, expected = [], set()
    for n in [25, 26, 30, 40, 51, 60, 150] * 3:
        passage = " ".join(word() for _ in range(n))
        for _ in range(2):
            before = " ".join(word() for _ in range(draw.randint(20, 60))) + " "
            text = before + passage + " " + " ".join(word() for _ in range(draw.randint(20, 60)))
            expected.add((len(rows), len(before), len(before) + len(passage), n, len(rows) % 2 == 1))
            rows.append((len(rows), text))
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["words"], r["removed"]) for r in found} == expected
    assert len(found) == len(expected)


def test_paragraph_sketches_hold_the_sets_of_the_texts(spark):
    draw = random.Random(17)
    word = lambda: "".join(draw.choice("abcDEF") for _ in range(draw.randint(1, 3)))
    lines = [" ".join(word() for _ in range(draw.randint(1, 40))) for _ in range(150)]
    cycle = "one two three four five six "
    lines += [cycle * 3, cycle * 9, cycle.upper() * 4, "ruler " * 12, "ruler " * 25]
    near = [word() + str(i) for i in range(100)]
    lines += [" ".join(near), " ".join([*near[:-1], "other"])]
    draw.shuffle(lines)
    rows = [("\n".join(lines[at:at + 7]) + draw.choice(["", "\n", " \t"]),) for at in range(0, len(lines), 7)] + [(None,), ("",), (" ".join(near * 300),)]
    docs = spark.createDataFrame(rows, "text string")
    texts = {r["id"]: r["text"].lower().split() for r in substrings.paragraph_texts(docs).collect()}
    sets = {i: frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) for i, w in texts.items()}
    found = {r["id"]: r for r in substrings.paragraph_sketches(docs, substrings.PARAGRAPHS).collect()}
    assert {i: r["n"] for i, r in found.items()} == {i: len(x) for i, x in sets.items()}
    keys = {i: (r["k1"], r["k2"], tuple(r["bands"])) for i, r in found.items()}
    assert len(set(keys.values())) == len(set(sets.values())) == len(set(zip(keys.values(), (sets[i] for i in keys), strict=True)))
    one, two = (found[i]["bands"] for i, w in texts.items() if len(w) == 100)
    assert len(one) == substrings.BANDS and set(one) & set(two)


def test_rows_that_repeat_are_occurrences(spark):
    draw = random.Random(16)
    text = " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    rows = [(1, text), (1, text), (None, "x y z " + text), (None, text + " u v w")]
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).filter("kind = 'piece'").collect()
    assert sorted((r["doc_id"] or 0, r["words"], r["removed"]) for r in found) == [(0, 40, False), (0, 40, True), (1, 40, True), (1, 40, True)]


def test_surroundings_of_pieces_are_joined_once(spark, monkeypatch):
    # With tables that are too large to broadcast, a join shuffles every word around every piece.
    plans = {}

    def watched(df, name, stays=False):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name, stays)

    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(substrings, "written", watched)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a b " + text), (2, "c d " + text), (2, "c d " + text), (3, text + " e f")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.repeats(documents).filter("kind = 'piece'").collect()
    assert plans["matches"].count("Join") == 1
    assert {(r["doc_id"], r["removed"]) for r in found if r["words"] == 40} == {(1, False), (2, True), (3, True)}


def test_equal_texts_are_cut_and_compared_once(spark, monkeypatch):
    tables = {}

    def watched(df, name, stays=False):
        tables[name] = written(df, name, stays)
        return tables[name]

    monkeypatch.setattr(substrings, "written", watched)
    text, other = (" ".join(f"{k}{i}" for i in range(60)) for k in "vw")
    # ``inner`` has no piece of its own: all of them stand in document 0 before.
    inner = " ".join(f"u{i}" for i in range(40))
    rows = [(0, f"a b {inner} c d")] + [(i, text) for i in range(1, 6)] + [(6, inner), (7, inner), (8, other), (8, other), (None, f"{other}  {other}")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.repeats(documents).filter("kind = 'piece' and words >= 40").collect()
    assert tables["occurrences"].count() == 5
    assert "who" in tables["pieces"].columns and tables["pieces"].filter("who.doc_id between 1 and 5").isEmpty()
    several = {}
    for r in found:
        several.setdefault((r["words"], r["doc_id"], r["removed"]), []).append((r["start"], r["end"]))
    n, m = len(other), len(inner)
    assert several == {
        **{(60, i, i > 1): [(0, len(text))] for i in range(1, 6)},
        (40, 0, False): [(4, 4 + m)], (40, 6, True): [(0, m)], (40, 7, True): [(0, m)],
        (60, 8, True): [(0, n), (0, n)], (60, None, False): [(0, n)], (60, None, True): [(n + 2, 2 * n + 2)],
    }


def test_cover_tree_equals_brute_force():
    draw = np.random.default_rng(6)
    for spread, cosine in ((0.05, 0.93), (0.5, 0.9), (3.0, 0.2)):
        points = np.repeat(draw.standard_normal((6, 8)), 60, axis=0) + spread * draw.standard_normal((360, 8))
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        ids, weight = np.arange(360), draw.integers(1, 4, 360)
        near = points @ points.T >= cosine
        np.fill_diagonal(near, False)
        own, _, forest = covertree.links(points, None, ids, None, weight, None, cosine)
        assert (own == near @ weight).all()
        assert [forest.find(i) for i in ids] == [closure(ids, np.argwhere(near))[i] for i in ids]
        a, b = points[:200], points[200:]
        one, two, _ = covertree.links(a, b, ids[:200], ids[200:], weight[:200], weight[200:], cosine)
        cross = a @ b.T >= cosine
        assert (one == cross @ weight[200:]).all() and (two == cross.T @ weight[:200]).all()


@pytest.mark.parametrize("block", [20, 2000])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    draw = np.random.default_rng(8)
    centres = draw.standard_normal((8, 6))
    rows = []
    for i in range(160):
        rows.append((i, [float(x) for x in np.float32(centres[i % 8] + 0.35 * draw.standard_normal(6))], i % 3, "x"))
    rows += [(160, rows[0][1], 0, "x"), (161, [2 * x for x in rows[0][1]], 0, "x"), (162, None, 0, "x"), (163, [0.0] * 6, 0, "x")]
    rows += [(164, [float("nan")] * 6, 0, "x"), (165, rows[1][1], None, "x"), (166, [1.0, 2.0], 0, "x"), (167, [], 1, "x"), (168, [None] + [1.0] * 5, 1, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    links = []
    for i, a, x, _ in rows:
        for j, b, y, _ in rows:
            if i != j and x == y and x is not None and a and b and len(a) == len(b) and None not in a and None not in b:
                u, v = np.array(a), np.array(b)
                n = np.linalg.norm(u) * np.linalg.norm(v)
                if np.isfinite(n) and n > 0 and u @ v / n >= 0.93:
                    links.append((i, j))
    part = closure([r[0] for r in rows], links)
    count = {r[0]: sum(a == r[0] for a, _ in links) for r in rows}
    found = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.cosine_links(frame).collect()}
    assert found == {i: (count[i], part[i]) for i in count}
    assert embeddings.cosine_links(frame.limit(0)).count() == 0


def test_one_of_each_shuffles_only_texts_of_repeated_ids(spark):
    from reclattice.session import checkpoint_dir
    import os

    words = [[f"w{i}x{k}" for k in range(30)] for i in range(40)]
    rows = [(i, " ".join(words[i])) for i in range(40)] + [(40, " ".join(words[3])), (None, " ".join(words[3]))]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    before = set(os.listdir(checkpoint_dir(spark)))
    kept = neardup.one_of_each(documents)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == list(range(40)) and kept.count() == 41
    assert "SortAggregate" not in kept._jdf.queryExecution().toString() and "first(text" not in kept._jdf.queryExecution().toString()
    # Tables of the search are deleted with it.
    made = {name.split("-")[0] for name in set(os.listdir(checkpoint_dir(spark))) - before}
    assert made <= {"kept", "repeated"}
    # Repeats of an id: equal texts once, different texts each.
    again = documents.union(spark.createDataFrame([rows[5], (6, " ".join(f"v{k}" for k in range(30)))], documents.schema))
    found = sorted((r["doc_id"], r["text"][0]) for r in neardup.one_of_each(again).filter("doc_id is not null").collect())
    assert found == sorted([(i, "w") for i in range(40)] + [(6, "v")])


def test_one_of_each_broadcasts_few_kept_ids(spark):
    """Whatever the session's own threshold, texts are not shuffled to meet a small table of ids."""
    documents = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(20)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = neardup.one_of_each(documents)
        assert kept.count() == 20 and "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
