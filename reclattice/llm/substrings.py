"""Passages that repeat across documents: near-equal paragraphs and equal pieces of longer text.

Paragraphs are lines of at least ``PARAGRAPH`` words (rulers, one word again and again, from
``RULER`` words on); MinHash bands bring near-equal ones together
and an exact Jaccard similarity confirms them. A passage may also stand in the middle of
different paragraphs. So of every ``WINDOW`` neighbouring runs of ``PIECE`` words the one with the
least hash is a piece, whatever stands around: texts that share ``WINDOW + PIECE - 1`` words share
a piece. Each equal piece is then extended to both sides, word by word, as far as its text agrees
with the text of the first occurrence. Of each cluster the first occurrence stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reclattice.llm.common import add_columns, passing, written
from reclattice.llm.similar import Settings, clusters
from reclattice.llm.sketches import EMPTY, M2, ODD, MinHash, Words, band_keys, mix, set_keys, text_groups, tune_bands
from reclattice.session import BROADCAST_BYTES, ship_package

# The width of a shingle: shorter lines have no set of their own.
PARAGRAPH = 5
# A line of one word again and again is a ruler or a table border below this length.
RULER = 20
# Paragraph ids that a task remembers, so that common lines are sketched once.
SEEN = 250_000
# Words of a piece, and of how many neighbouring runs one is a piece.
PIECE, WINDOW = 10, 16
# Runs with fewer different words (rulers, table borders) are no piece.
DIFFERENT = 4
# Words on either side of an equal piece that are compared before texts are joined: a passage
# reaches fewer than WINDOW words beyond its last piece.
SIDE = WINDOW
SIMILARITY, MISS, COORDINATES = 0.8, 1e-4, 20
BANDS, ROWS = tune_bands(SIMILARITY, MISS, COORDINATES)
PARAGRAPHS = Settings(sketch=MinHash, bands=BANDS, rows=ROWS, width=PARAGRAPH, one_text=True)

# First words, numbers of words and ids of some runs of words.
Units = tuple[np.ndarray, np.ndarray, np.ndarray]
NO_UNITS = (np.zeros(0, np.int64),) * 3


class Cut(Words):
    """Lines and pieces of some texts."""

    def runs(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, hash) of the word runs that begin at ``first`` and follow each other."""
        length = np.diff(np.append(first, len(self.hash)))
        place = (np.arange(len(self.hash)) - np.repeat(first, length)).astype(np.uint64)
        return length, np.add.reduceat(mix(self.hash * ODD + place * M2), first).view(np.int64)

    def paragraphs(self) -> Units:
        """(first word, words, id) of every line that is long enough."""
        if not len(self.hash):
            return NO_UNITS
        first = np.append(0, np.searchsorted(self.place, np.flatnonzero(self.code == 10)))
        first = first[np.append(first[1:] != first[:-1], True) & (first < len(self.hash))]
        length, ids = self.runs(first)
        ruler = np.minimum.reduceat(self.hash, first) == np.maximum.reduceat(self.hash, first)
        keep = (length >= PARAGRAPH) & (~ruler | (length >= RULER))
        return first[keep], length[keep], ids[keep]

    def pieces(self) -> Units:
        """(first word, words, id) of the pieces."""
        n = len(self.hash)
        if n < PIECE:
            return NO_UNITS
        many = n - PIECE + 1
        two = mix(self.hash[:-1] * ODD + self.hash[1:])
        four = mix(two[:-2] * ODD + two[2:])
        ids = mix(mix(four[:-4] * ODD + four[4:])[:many] * ODD + two[8:])
        # How far before a word the same word stands, if inside of a run.
        near = np.full(n, PIECE, np.int8)
        for k in range(PIECE - 1, 0, -1):
            near[k:][self.hash[k:] == self.hash[:-k]] = k
        # Words of the run that stand before in the run itself are not new to it.
        again = np.zeros(many, np.int8)
        for k in range(PIECE):
            again += near[k:k + many] <= k
        ids[(PIECE - again < DIFFERENT) | (self.text[PIECE - 1:] != self.text[:many])] = EMPTY
        # The place of the least of WINDOW neighbours, the first of equal ones, by doubling.
        first = np.zeros(0, np.int64)
        if many >= WINDOW:
            least, place, width = ids, np.arange(many), 1
            while width < WINDOW:
                step = min(width, WINDOW - width)
                right = least[step:] < least[:-step]
                least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
                width += step
            first = place[self.text[WINDOW + PIECE - 2:] == self.text[:len(place)]]
        runs = np.diff(self.first) - PIECE + 1
        # Texts with fewer runs have one piece.
        short = [self.first[i] + ids[self.first[i]:][:runs[i]].argmin() for i in np.flatnonzero((runs > 0) & (runs < WINDOW))]
        first = np.unique(np.append(first, np.array(short, np.int64)))
        first = first[ids[first] != EMPTY]
        return first, np.full(len(first), PIECE), ids[first].view(np.int64)


def _listed(row: np.ndarray, values: pa.Array, rows: int) -> pa.ListArray:
    """``values`` as one list for each of ``rows`` rows; ``row``, ascending, says whose they are."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype(np.int32)), values)


def _records(columns: dict[str, np.ndarray | pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


class Sketcher:
    """Sketches of the paragraphs that a task has not met before, while it remembers them."""

    def __init__(self, settings: Settings):
        self.settings, self.sketch, self.seen = settings, settings.sketch(settings.size), Seen()

    def __call__(self, cut: Cut, first: np.ndarray, words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, dict]:
        """Which paragraphs are new, and their columns."""
        new = self.seen.fresh(ids)
        which, key = cut.shingles(first[new], words[new], self.settings.width)
        size = np.bincount(which, minlength=int(new.sum()))
        starts = np.cumsum(size) - size
        if len(size):
            bands = band_keys(self.sketch.many(key, starts), self.settings.rows)
            keys = set_keys(key, starts)
        else:
            bands, keys = np.zeros((0, self.settings.bands), np.int64), (ids[:0], ids[:0])
        at = np.arange(0, bands.size + 1, self.settings.bands, dtype=np.int32)
        return new, {
            "id": ids[new], "n": size.astype(np.int64), "k1": keys[0], "k2": keys[1],
            "bands": pa.ListArray.from_arrays(pa.array(at), pa.array(bands.ravel())),
        }


SKETCH = "id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"


def _check(settings: Settings) -> None:
    if settings.width > PARAGRAPH:
        raise ValueError(f"shingles of {settings.width} words do not fit paragraphs of {PARAGRAPH}")


def occurrences(documents: DataFrame, settings: Settings) -> DataFrame:
    """(who, words, start, end, paragraphs, at, piece, sketches) of documents (who, text), which are
    cut once: how many words they have and where these reach; (at, start, end, words, id) of every
    paragraph; first word and id of every piece; what ``similar.sketched`` gives for paragraphs that
    the task did not give before.

    An id hashes the words; case of A-Z and the kind of white space do not matter to it.
    """
    _check(settings)
    ship_package(documents.sparkSession)
    whose = documents.schema["who"].dataType.simpleString()

    def run(batches):
        sketcher = Sketcher(settings)
        for batch in batches:
            for begin, (texts,) in text_groups(batch.column(1)):
                cut, rows = Cut(texts), len(texts)
                first, words, ids = cut.paragraphs()
                at, _, pieces = cut.pieces()
                new, sketches = sketcher(cut, first, words, ids)
                row, own, count = cut.text[first], cut.text[at], np.diff(cut.first)
                start, end = np.zeros(rows, np.int32), np.zeros(rows, np.int32)
                some = count > 0
                start[some], end[some] = cut.start[cut.first[:-1][some]], cut.end[cut.first[1:][some] - 1]
                paragraphs = _records({
                    **{name: x.astype(np.int32) for name, x in (
                        ("at", first - cut.first[row]), ("start", cut.start[first]), ("end", cut.end[first + words - 1]), ("words", words),
                    )}, "id": ids,
                })
                yield pa.RecordBatch.from_pydict({
                    "who": batch.column(0).slice(begin, rows), "words": count.astype(np.int32), "start": start, "end": end,
                    "paragraphs": _listed(row, paragraphs, rows),
                    "at": _listed(own, pa.array((at - cut.first[own]).astype(np.int32)), rows),
                    "piece": _listed(own, pa.array(pieces), rows),
                    "sketches": _listed(row[new], _records(sketches), rows),
                })

    return documents.select("who", "text").mapInArrow(run, (
        f"who {whose}, words int, start int, end int, paragraphs array<struct<at: int, start: int, end: int, words: int, id: bigint>>, "
        f"at array<int>, piece array<bigint>, sketches array<struct<{SKETCH}>>"
    ))


class Seen(set):
    """Paragraph ids that a task has given; emptied when full."""

    def fresh(self, ids: np.ndarray) -> np.ndarray:
        """Whether each id comes for the first time."""
        if len(self) >= SEEN:
            self.clear()
        new = np.zeros(len(ids), bool)
        for i, key in enumerate(ids.tolist()):
            if key not in self:
                self.add(key)
                new[i] = True
        return new


def paragraph_texts(documents: DataFrame) -> DataFrame:
    """(id, text) of every paragraph; a task gives equal ones once while it remembers them."""
    ship_package(documents.sparkSession)

    def run(batches):
        seen = Seen()
        for batch in batches:
            for _, (texts,) in text_groups(batch.column(0)):
                cut = Cut(texts)
                first, words, key = cut.paragraphs()
                new = seen.fresh(key)
                ends = zip(cut.place[first[new]].tolist(), cut.stop[first[new] + words[new] - 1].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array([cut.data[s:e] for s, e in ends], pa.string())], names=["id", "text"])

    return documents.select("text").mapInArrow(run, "id bigint, text string")


def paragraph_sketches(documents: DataFrame, settings: Settings) -> DataFrame:
    """What ``similar.sketched`` gives for ``paragraph_texts``, by whole groups of documents: the
    shingles are made of the words' hashes as they lie in the documents, and no text is sent."""
    _check(settings)
    ship_package(documents.sparkSession)

    def run(batches):
        sketcher = Sketcher(settings)
        for batch in batches:
            for _, (texts,) in text_groups(batch.column(0)):
                cut = Cut(texts)
                yield pa.RecordBatch.from_pydict(sketcher(cut, *cut.paragraphs())[1])

    return documents.select("text").mapInArrow(run, SKETCH)


def _distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (who, text) with every text once, at its first id, and (who, doc_id, times, own)
    of all ids of the texts that occur in several rows: their number of rows, and whether ``who``,
    the first, has this id."""
    each = docs.groupBy("who", F.xxhash64(F.lit(1), "text").alias("other")).agg(F.count("*").alias("times"))
    each = each.withColumn("key", F.col("who.key"))
    several = each.groupBy("key", "other").agg(F.sum("times").alias("rows"), F.min("who").alias("first")).filter("rows > 1")
    members = written(
        each.join(several, ["key", "other"])
        .select(F.col("first").alias("who"), F.col("who.doc_id").alias("doc_id"), "times", F.col("who").eqNullSafe(F.col("first")).alias("own")),
        "members",
    )
    many = members.count()
    if not many:
        return docs, members

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if many * 64 <= BROADCAST_BYTES else df

    later = members.filter("not own").select(F.struct("doc_id", F.col("who.key").alias("key")).alias("who"))
    once = docs.join(small(later), "who", "left_anti")
    again = members.filter("own and times > 1").select("who")
    if not again.isEmpty():
        rows = once.join(small(again), "who", "left_semi").dropDuplicates(["who"])
        once = once.join(small(again), "who", "left_anti").unionByName(rows)
    return once, members


def _copied(found: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, words, cluster, removed): the passages ``found`` of distinct texts (with
    ``who``, not doc_id) in all rows of these texts. Only rows of the first id can stay."""
    everywhere = found.join(members, "who", "left").withColumn("doc_id", F.when(F.col("times").isNull(), F.col("who.doc_id")).otherwise(F.col("doc_id")))
    return everywhere.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int")))).select(
        "doc_id", "kind", "start", "end", "words", "cluster", (F.col("removed") | ~F.coalesce("own", F.lit(True))).alias("removed")
    )


def _fixed(values: np.ndarray) -> pa.Array:
    """The rows of a table of bytes as binary values."""
    many, width = values.shape
    edges = np.arange(many + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(values))])


def _unfixed(column: pa.Array, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, distances) of ``side`` words per row, as ``_surroundings`` packs them."""
    column = column.cast(pa.binary())
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    values = np.frombuffer(column.buffers()[2], np.uint8)[begin:begin + len(column) * side * 12] if len(column) else np.zeros(0, np.uint8)
    values = values.reshape(len(column), side * 12)
    return values[:, :side * 8].copy().view(np.uint64), values[:, side * 8:].copy().view(np.int32)


def _surroundings(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(who, at, id, leads, start, end, left_words, left, right_words, right) of the pieces ``common`` (who,
    at, id, leads): of up to ``SIDE`` words on either side, the nearest first, how many there are, and packed
    their hashes and how far before the start or behind the end of the piece they reach."""
    places = written(
        common.groupBy("who").agg(F.sort_array(F.collect_list(F.struct("at", "id", "leads"))).alias("places")), "places"
    )
    holders = places.select("who")
    # Only texts with such a piece are shuffled.
    if holders.count() * 64 <= BROADCAST_BYTES:
        docs = docs.join(F.broadcast(holders), "who", "left_semi")
    ship_package(docs.sparkSession)
    held = docs.join(places, "who").select("who", *[F.col(f"places.{c}").alias(c) for c in ("at", "id", "leads")], "text")
    kind = held.schema["who"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for begin, (texts,) in text_groups(batch.column(4)):
                cut, part = Cut(texts), batch.slice(begin, len(texts))
                row = np.repeat(np.arange(len(texts)), pc.list_value_length(part.column(1)).to_numpy())
                at = part.column(1).flatten()
                own = cut.first[row] + at.to_numpy()
                start, end = cut.start[own], cut.end[own + PIECE - 1]
                columns = {
                    "who": part.column(0).take(pa.array(row)), "at": at, "id": part.column(2).flatten(), "leads": part.column(3).flatten(),
                    "start": start.astype(np.int32), "end": end.astype(np.int32),
                }
                for side, place, edge, base in (
                    ("left", own[:, None] - 1 - np.arange(SIDE), cut.start, start),
                    ("right", own[:, None] + PIECE + np.arange(SIDE), cut.end, end),
                ):
                    inside = (place >= cut.first[row][:, None]) & (place < cut.first[row + 1][:, None])
                    place = np.where(inside, place, own[:, None])
                    hashes = np.where(inside, cut.hash[place], np.uint64(0))
                    far = np.where(inside, np.abs(edge[place] - base[:, None]), 0).astype(np.int32)
                    columns[f"{side}_words"] = inside.sum(axis=1).astype(np.int32)
                    columns[side] = _fixed(np.concatenate([hashes.view(np.uint8), far.view(np.uint8)], axis=1))
                yield pa.RecordBatch.from_pydict(columns)

    return held.mapInArrow(run, (
        f"who {kind}, at int, id bigint, leads boolean, start int, end int, "
        "left_words int, left binary, right_words int, right binary"
    ))


def _grown(joined: DataFrame) -> DataFrame:
    """(who, first, shift, lo, hi, start, end, first_start, first_end, open_left, open_right): pieces beside
    their first occurrences, extended as far as the words around both agree."""
    joined = joined.select(
        "who", "first", *[f"{p}{c}" for c in ("at", "start", "end", "left_words", "right_words", "left", "right") for p in ("", "first_")]
    )
    kind = joined.schema["who"].dataType.simpleString()
    width = SIDE

    def run(batches):
        for batch in batches:
            own = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            number = {name: x.to_numpy() for name, x in own.items() if pa.types.is_integer(x.type)}
            reach, rows = {}, np.arange(len(batch))
            for side in ("left", "right"):
                (one, far), (two, first_far) = (_unfixed(own[p + side], width) for p in ("", "first_"))
                both = np.minimum(number[f"{side}_words"], number[f"first_{side}_words"])
                same = (one == two) & (np.arange(width) < both[:, None])
                many = np.where(same.all(axis=1), width, same.argmin(axis=1))
                last = np.maximum(many - 1, 0)
                reach[side] = many, [np.where(many > 0, x[rows, last], 0) for x in (far, first_far)]
            (l, before), (r, behind) = reach["left"], reach["right"]
            yield pa.RecordBatch.from_pydict({
                "who": own["who"], "first": own["first"], "shift": number["at"] - number["first_at"],
                "lo": (number["at"] - l).astype(np.int32), "hi": (number["at"] + PIECE + r).astype(np.int32),
                "start": number["start"] - before[0], "end": number["end"] + behind[0],
                "first_start": number["first_start"] - before[1], "first_end": number["first_end"] + behind[1],
                "open_left": l == width, "open_right": r == width,
            })

    return joined.mapInArrow(run, (
        f"who {kind}, first {kind}, shift int, lo int, hi int, start int, end int, first_start int, first_end int, "
        "open_left boolean, open_right boolean"
    ))


def _extended(docs: DataFrame, unfinished: DataFrame) -> DataFrame:
    """``unfinished`` (matches, see below) extended on the texts to where these stop agreeing."""
    columns = unfinished.columns
    inner = [c for c in columns if c not in ("who", "first")]
    pairs = unfinished.groupBy("who", "first").agg(F.collect_list(F.struct(*inner)).alias("matches"))
    needed = unfinished.select(F.explode(F.array("who", "first")).alias("who")).distinct()
    texts = docs.join(needed, "who", "left_semi")
    joined = pairs.join(texts, "who").join(
        texts.select(F.col("who").alias("first"), F.col("text").alias("first_text")), "first"
    )

    def one(matches, text, first_text):
        b, a = Cut([text.encode()]), Cut([first_text.encode()])
        for m in matches:
            lo, hi = m["lo"], m["hi"]
            shift = m["shift"]
            n = min(lo, lo - shift)
            differ = np.flatnonzero(b.hash[lo - n:lo][::-1] != a.hash[lo - shift - n:lo - shift][::-1])
            lo -= int(differ[0]) if len(differ) else n
            n = min(len(b.hash) - hi, len(a.hash) - (hi - shift))
            differ = np.flatnonzero(b.hash[hi:hi + n] != a.hash[hi - shift:hi - shift + n])
            hi += int(differ[0]) if len(differ) else n
            m |= {
                "lo": lo, "hi": hi, "start": int(b.start[lo]), "end": int(b.end[hi - 1]),
                "first_start": int(a.start[lo - shift]), "first_end": int(a.end[hi - shift - 1]),
            }
        return matches

    def make():
        def step(matches, texts, first_texts):
            rows = zip(matches.to_pylist(), texts.to_pylist(), first_texts.to_pylist(), strict=True)
            return [pa.array([one(*row) for row in rows], matches.type)]

        return step

    kind = joined.schema["matches"].dataType.simpleString()
    done = add_columns(joined.withColumnRenamed("matches", "before"), ["before", "text", "first_text"], f"matches {kind}", make)
    return done.select("who", "first", F.explode("matches").alias("m")).select("who", "first", "m.*").select(columns).distinct()


def _passages(docs: DataFrame, cuts: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, words, cluster, removed) of what equal pieces grow to.

    A match says that words ``lo`` to ``hi`` of ``who`` are, ``shift`` places earlier, words of the
    document ``first``, which holds the first occurrence of one of its pieces. Matches of several
    pieces at one shift are one. Texts are compared once; a copy of a text that holds the first
    occurrence of a piece agrees with it from end to end.
    """
    repeated = written(
        cuts.select(F.explode("piece").alias("id")).groupBy("id").agg(F.count("*").alias("times")).filter("times > 1").select("id"),
        "repeated",
    )
    many = repeated.count()

    def small(df: DataFrame, row_bytes: int) -> DataFrame:
        return F.broadcast(df) if many * row_bytes <= BROADCAST_BYTES else df

    pieces = cuts.select("who", F.explode(F.arrays_zip("at", "piece")).alias("p")).select("who", "p.at", F.col("p.piece").alias("id"))
    common = written(pieces.join(small(repeated, 32), "id"), "common")
    origin = common.groupBy("id").agg(F.min(F.struct("who", "at")).alias("origin"))
    common = written(
        common.join(small(origin, 64), "id").select(
            "who", "at", "id", F.col("origin").eqNullSafe(F.struct("who", "at")).alias("leads"),
            F.col("origin.who").eqNullSafe(F.col("who")).alias("here"),
        ),
        "common",
    )
    # Texts with several rows that hold the first occurrence of a piece, be it the only one.
    reps = members.filter("own").select("who")
    elsewhere = common.filter("not here").join(reps, "who", "left_semi").groupBy("who").agg(F.count("*").alias("elsewhere"))
    whole = cuts.join(reps, "who", "left_semi").join(elsewhere, "who", "left").filter("size(piece) > coalesce(elsewhere, 0)").select(
        "who", "start", "end", "words", F.xxhash64("who", F.lit(0), "words").alias("cluster")
    )
    with passing(docs.sparkSession):
        around = written(_surroundings(docs, common.drop("here")), "pieces", stays=True)
    names = {"who": "first", **{c: f"first_{c}" for c in ("at", "start", "end", "left_words", "left", "right_words", "right")}}
    origins = around.filter("leads").drop("leads").withColumnsRenamed(names)
    grown = _grown(around.filter("not leads").join(small(origins, 768), "id"))
    line = Window.partitionBy("who", "first", "shift").orderBy("lo", "hi")
    reached = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("lo") > reached).cast("int"), F.lit(1))
    left, right = F.struct("start", "first_start", "open_left"), F.struct("end", "first_end", "open_right")
    matches = (
        grown.withColumn("new", new).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("who", "first", "shift", "run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by(left, "lo").alias("left"), F.max_by(right, "hi").alias("right"))
        .drop("run").select("*", "left.*", "right.*").drop("left", "right")
    )
    matches = written(matches, "matches")
    loose = F.col("open_left") | F.col("open_right")
    matches = matches.drop("open_left", "open_right").filter(~loose).unionByName(
        _extended(docs, matches.filter(loose).drop("open_left", "open_right"))
    )
    matches = written(
        matches.withColumn("words", F.col("hi") - F.col("lo"))
        .withColumn("cluster", F.xxhash64("first", F.col("lo") - F.col("shift"), "words")),
        "matches",
    )
    columns = ["who", F.lit("piece").alias("kind"), "start", "end", "words", "cluster"]
    later = matches.select(*columns, F.lit(True).alias("removed"))
    firsts = matches.select(F.col("first").alias("who"), F.col("first_start").alias("start"), F.col("first_end").alias("end"), "words", "cluster")
    firsts = firsts.union(whole).distinct().select(*columns, F.lit(False).alias("removed"))
    copies = whole.select(*columns, F.lit(True).alias("removed")).join(members.filter("not own").select("who").distinct(), "who", "left_semi")
    return (
        _copied(later, members)
        .union(_copied(firsts, members.filter("own")))
        .union(_copied(copies, members.filter("not own")))
    )


def repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = PARAGRAPHS) -> DataFrame:
    """(doc_id, kind, start, end, words, cluster, removed): every passage that occurs twice or more.

    Offsets count code points, ``end`` is exclusive. ``removed`` is false for the first occurrence
    by (doc_id, start) and true for the others. A piece reaches as far as its text agrees with the
    first occurrence, which appears once per such length. Null, empty and short texts have no
    passages; rows without an id sort first; repeated rows are occurrences of their own. Documents
    without a repeated passage do not appear.
    """
    docs = documents.select(
        F.struct(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("key")).alias("who"),
        F.col(f"`{text}`").alias("text"),
    )
    docs, members = _distinct_texts(docs)
    cuts = written(occurrences(docs, settings), "occurrences")
    found = cuts.select("who", F.explode("paragraphs").alias("p")).select("who", "p.*")

    def texts(ids: DataFrame) -> DataFrame:
        # Only documents that hold one of the paragraphs are cut again.
        holders = found.join(ids, "id", "left_semi").select("who").distinct()
        if holders.count() * 32 <= BROADCAST_BYTES:
            holders = F.broadcast(holders)
        return paragraph_texts(docs.join(holders, "who", "left_semi")).join(ids, "id", "left_semi")

    sketches = cuts.select(F.explode("sketches").alias("s")).select("s.*")
    with passing(docs.sparkSession):
        parts = clusters(paragraph_texts(docs), settings, texts, sketches).filter("id <> component")
        parts = written(parts.select("id", "component").distinct(), "paragraphs", stays=True)
    known = (
        found.join(parts.withColumnRenamed("component", "cluster"), "id", "left").withColumn("kind", F.lit("paragraph"))
        .withColumn("cluster", F.coalesce("cluster", "id"))
    )
    several = members.filter("own").select("who", F.lit(True).alias("several"))
    sizes = written(
        known.join(several, "who", "left").groupBy("cluster")
        .agg(F.count("*").alias("times"), F.max("several").alias("several"), F.min(F.struct("who", "at")).alias("first"))
        .filter("times > 1 or several")
        .select("cluster", "first"),
        "repeated",
    )
    # Clusters that repeat are few beside all paragraphs: broadcast while their number is small.
    if sizes.count() * 64 <= BROADCAST_BYTES:
        sizes = F.broadcast(sizes)
    paragraphs = known.join(sizes, "cluster").withColumn("removed", ~F.struct("who", "at").eqNullSafe(F.col("first")))
    return _copied(paragraphs.drop("at", "first"), members).union(_passages(docs, cuts, members))


def without_repeats(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the removed passages of ``repeats`` cut out of their texts."""
    spans = found.filter("removed").groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    joined = documents.join(spans, F.col(f"`{doc_id}`").eqNullSafe(F.col("__doc")), "left").drop("__doc")

    def cut(value: str | None, spans) -> str | None:
        if not spans or value is None:
            return value
        parts, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
            if s["start"] > at:
                parts.append(value[at:s["start"]])
            at = max(at, s["end"])
        return "".join([*parts, value[at:]])

    def make():
        return lambda texts, spans: [pa.array([cut(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())]

    return add_columns(joined, [text, "__spans"], f"`{text}` string", make).select(documents.columns)
