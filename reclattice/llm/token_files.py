"""Token ids as ORC files: run-length encoded integers, row indexes and Bloom filters on the id.

Rows are range partitioned and sorted by document id, so every file covers a range of ids and a
reader of some ids prunes files, stripes and row groups by their metadata. Each row holds where
its ids begin within its file; where a file begins in the whole sequence follows from the files'
totals, so no task ever counts over all rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reclattice.llm.common import add_columns
from reclattice.session import shuffle_partitions

END_ID = 1
# Remembered per Python worker: whether other letters than ASCII ones may part from marks behind them,
# and, in each of two generations, what the library gave for words without such marks.
MEMO_ENTRIES = 50_000
CORE_ENTRIES = 250_000
MEMO_LENGTH = 64
# Bytes of texts that are cut into words at a time, but for a longer text.
GROUP_BYTES = 8 << 20
# Marks that may stand behind a word. An apostrophe may begin a match with what follows it.
MARKS = string.punctuation.replace("'", "")
# Words of letters that the library gets as one text.
JOINED = 1000


def _letters(core: str) -> bool:
    """Whether the core is letters and ends in one after the tokenizer's own NFC and lower-casing,
    which turn some letters into a letter and a mark; such a mark goes with the stop behind it."""
    if core.isascii():
        return core.isalpha()
    core = unicodedata.normalize("NFC", core)
    return core.isalpha() and core[-1].lower().isalpha()


class Generations:
    """A memo of ids by word in two generations: when the younger one is full it becomes the older,
    so that words met since stay. The empty word has no ids."""

    def __init__(self, entries: int):
        self.entries = entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> list[str]:
        """Those of ``words`` that are not known; the others are in the younger generation now."""
        if len(self.young) >= self.entries:
            self.young, self.old = {}, self.young
        self.young[""] = b""
        new = words.difference(self.young)
        unknown = new.difference(self.old)
        self.young.update((word, self.old[word]) for word in new.difference(unknown))
        return list(unknown)


class WordCodec:
    """A tokenizer whose matches never span white space, applied to distinct words only."""

    def __init__(self, content: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        # Added tokens are matched inside words and before any lower-casing, which must not make one.
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE).search
        # A word with an added token holds one of these marks; None if a token has no mark.
        marks = {next((c for c in token if c in string.punctuation), "") for token in added}
        self.added_marks = None if "" in marks else "".join(sorted(marks))
        self.cores, self.letters = Generations(CORE_ENTRIES), {}
        # Which ids end a match, if the file marks them.
        suffix = json.loads(content)["model"].get("end_of_word_suffix")
        self.last = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _learn(self, words: set[str]) -> list[str]:
        """Makes the ids of ``words`` known; returns those that are too long to stay so."""
        missing = self.cores.missing(words)
        known = self.cores.young
        single = [c for c in missing if _letters(c)] if self.last is not None else []
        for at in range(0, len(single), JOINED):
            part = single[at:at + JOINED]
            known.update(zip(part, self._joined(part), strict=True))
        rest = [c for c in missing if c not in known]
        known.update(zip(rest, self._each(rest), strict=True))
        return [c for c in missing if len(c) > MEMO_LENGTH]

    def _holds_added(self, words: pa.Array) -> np.ndarray:
        """Whether an added token is in each of the words."""
        maybe = np.ones(len(words), bool)
        if self.added_marks is not None:
            maybe[:] = False
            for mark in self.added_marks:
                maybe |= pc.match_substring(words, mark).to_numpy(zero_copy_only=False)
        maybe[maybe] = [bool(self.added(word)) for word in words.filter(pa.array(maybe)).to_pylist()]
        return maybe

    def _other_letters(self, core: str) -> bool:
        found = self.letters.get(core)
        if found is None:
            if len(self.letters) >= MEMO_ENTRIES:
                self.letters.clear()
            found = self.letters[core] = _letters(core)
        return found

    def _ids(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words. Marks after a letter are a match of their own, and ASCII letters are
        lower-cased by the tokenizer anyway: both spare the library most of the distinct words."""
        core = pc.ascii_rtrim(words, MARKS)
        behind = pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy()
        plain = pc.string_is_ascii(core).to_numpy(zero_copy_only=False)
        apart = plain & pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False)
        other = ~plain & (behind > 0)
        apart[other] = [self._other_letters(c) for c in core.filter(pa.array(other)).to_pylist()]
        added = self._holds_added(words)
        apart &= (behind > 0) & ~added
        core = pc.if_else(pa.array(apart), core, words)
        core = pc.if_else(pa.array(plain & ~added), pc.ascii_lower(core), core).dictionary_encode()
        tails = [word[-n:] for word, n in zip(words.filter(pa.array(apart)).to_pylist(), behind[apart].tolist(), strict=True)]
        cores, marks = core.dictionary.to_pylist(), list(dict.fromkeys(["", *tails]))
        long = self._learn({*cores, *marks})
        known = self.cores.young
        found = pa.array([known[c] for c in cores], pa.large_binary()).take(core.indices)
        place = {mark: i for i, mark in enumerate(marks)}
        which = np.zeros(len(words), np.int32)
        which[apart] = [place[t] for t in tails]
        tail = pa.array([known[m] for m in marks], pa.large_binary()).take(pa.array(which))
        for word in long:
            known.pop(word, None)
        return pc.binary_join_element_wise(found, tail, pa.scalar(b"", pa.large_binary()))

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", one.ids).tobytes() for one in found]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each of which is one match: encoded as one text, which is cut
        behind the ids that end a match."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        data = ids.tobytes()
        if len(ends) != len(words) or ends[-1] != len(data):
            return self._each(words)
        return [data[one:two] for one, two in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: none) as little-endian 32-bit integers, a few texts at a time."""
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        out: list[bytes] = []
        while len(out) < len(texts):
            begin = len(out)
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + GROUP_BYTES, side="right")))
            lists = pc.split_pattern(pc.replace_substring(texts.slice(begin, end - begin), "\n", " "), " ")
            words = lists.flatten().dictionary_encode()
            found = self._ids(words.dictionary).take(words.indices)
            _, places, data = found.buffers()
            at = np.frombuffer(places, np.int64)[lists.offsets.to_numpy()].tolist()
            data = data.to_pybytes() if data else b""
            out += [data[one:two] for one, two in zip(at, at[1:])]
        return out


@lru_cache(maxsize=2)
def _cached(digest: str) -> list:
    return []


def codec_of(content: bytes) -> WordCodec:
    """The codec of a tokenizer file, built once per Python process."""
    slot = _cached(hashlib.sha256(content).hexdigest())
    if not slot:
        slot.append(WordCodec(content))
    return slot[0]


def write_tokens(
    df: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
    end_id: int = END_ID, files: int | None = None, stripe_bytes: int = 64 << 20, index_stride: int = 10_000,
) -> None:
    """Encode whole texts (null: empty), append ``end_id`` to each, and write ORC in id order.

    Columns: doc_id, file (which range), at (ids of earlier rows of the file), ids. Rows with
    equal ids keep a stable order by text; null ids come first. ``files`` defaults to the
    session's shuffle partitions. An empty table gives files without rows.
    """
    spark = df.sparkSession
    with open(tokenizer_path, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())

    def make():
        codec = codec_of(sent.value)
        end = np.array([end_id], "<u4").tobytes()
        total = 0

        def step(texts):
            nonlocal total
            data = [d + end for d in codec.encode(texts)]
            offsets = np.zeros(len(data) + 1, np.int32)
            np.cumsum([len(d) // 4 for d in data], out=offsets[1:])
            at = offsets[:-1].astype(np.int64) + total
            total += int(offsets[-1])
            ids = np.frombuffer(b"".join(data), "<i4")
            return [pa.array(at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))]

        return step

    # The hash of the text spreads rows that repeat one id over several ranges.
    ordered = (
        df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(files or shuffle_partitions(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", F.spark_partition_id().alias("file"), "text")
    )
    (
        add_columns(ordered, ["text"], "at bigint, ids array<int>", make)
        .select("doc_id", "file", "at", "ids")
        .write.option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .orc(path)
    )


SCHEMA = "doc_id bigint, file int, at bigint, ids array<int>"


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) from the files; ``start`` counts the ids of all documents before.

    The offsets come from one small aggregate over the files' totals, one row per file. A list
    of ``doc_ids`` reaches the scan as a filter and is answered from indexes and Bloom filters.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("file").agg(F.max(F.col("at") + F.size("ids")).alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(offsets), "file").select(
        "doc_id", (F.col("offset") + F.col("at")).alias("start"), "ids"
    )


def crc_of_ids(df: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """``df`` with the unsigned CRC-32 of each id list as little-endian 32-bit integers."""

    def make():
        def step(lists):
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            return [pa.array([zlib.crc32(flat[e - n:e].tobytes()) for n, e in zip(lengths, ends, strict=True)], pa.int64())]

        return step

    return add_columns(df, [ids], f"`{out}` bigint", make)
