"""Spans, byte-level BPE, ORC token files and decontamination against plain versions."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reclattice.llm import bpe, decontaminate, pii, queries, token_files
from reclattice.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n", "a", "Hello  world\n\n  it's 12 o'clock", "x" * 5000, "日本語 text — ünïcode 😀!!",
    "mail bob@ex-ample.com or +1 (269) 555-3296 4524132264652876 at 10.0.0.1, 4465758382889437 4465758382889437",
    "a@b.c@d.e _x@d.e ..@x.y 1.2.3.4.5.6.7.8 300.1.1.1 +49 30 1234567", "GB82 WEST 1234 5698 7654 32 iban", "\x1f\x85\xa0 odd  spaces\t.",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "en", "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[8], "en", "again"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, spans string")


def plain_spans(text):
    found = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(3)
    parts = ["a", "b@", "c.d", "@", ".", "1", "22", "255", " ", "-", "+", "(", ")", "4465758382889437", "x.y@z.co", "\n", "é"]
    for text in TEXTS + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(3000)]:
        spans = pii.spans_of(text)
        assert [s[:3] for s in spans if s[3]] == plain_spans(text)


def test_checks_and_added_spans():
    assert pii.luhn("4465758382889437") and not pii.luhn("4465758382889438")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    added = {(k, TEXTS[8][s:e]) for k, s, e, base, _ in pii.spans_of(TEXTS[8]) if not base}
    assert ("card", "4524132264652876") in added and ("phone", "+1 (269) 555-3296") in added
    assert [s[0] for s in pii.spans_of(TEXTS[10])] == ["iban"]
    assert [s[0] for s in pii.spans_of("ssn 123-45-6789")] == ["national_id"] and not pii.spans_of("part 123-45-6789")


def test_pii_rows_keep_columns_and_repeat(texts, spark):
    found = pii.find_spans(texts)
    assert found.columns == ["doc_id", "text", "lang", "spans"] and found.count() == texts.count()
    clean = {r["text"] for r in pii.redact(texts).filter("doc_id = 8").collect()}
    assert len(clean) == 1 and "bob@" not in clean.pop()
    assert pii.digest(pii.find_spans(texts.limit(0))).count() == 0
    row = pii.digest(found).filter("doc_id = 0").first()
    assert row["base_sha256"] == hashlib.sha256(b"").hexdigest() and row["spans"] == ""


def test_bpe_equals_the_library(texts):
    with open(PATH, "rb") as file:
        content = file.read()
    codec = bpe.codec_of(content, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(content), special_tokens={})
    draw = random.Random(5)
    parts = ["a", "th", "the", "é", "ß", "日", "😀", " ", "  ", "\n", "\t", "12", "'s", ".", "!!", "́", "\x1f", "\x85", "aaaa"]
    for text in [t or "" for t in TEXTS] + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 50))) for _ in range(3000)]:
        assert np.frombuffer(codec.encode(text), "<i4").tolist() == known.encode_ordinary(text)
    back = bpe.decode(bpe.encode(texts, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(back) == texts.count() and all((r["text"] or "").encode() == bytes(r["decoded"]) for r in back)


def test_round_trip_of_a_long_text_is_quick():
    with open(PATH, "rb") as file:
        codec = bpe.codec_of(file.read(), public_tokenizers.PATTERN)
    text = "a" * 200_000 + "thxyz" * 20_000
    assert len(np.frombuffer(codec.encode(text), "<i4")) > 10_000


def test_token_files(texts, spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(texts, path, public_tokenizers.path("word_bpe_49k.json"), files=3)
    rows = token_files.crc_of_ids(token_files.read_tokens(spark, path)).orderBy("start").collect()
    assert len(rows) == texts.count()
    at = 0
    for row in rows:
        assert row["start"] == at and row["ids_crc32"] == zlib.crc32(np.array(row["ids"], "<u4").tobytes())
        at += len(row["ids"])
    assert [r["doc_id"] for r in rows] == [None, *sorted([*range(len(TEXTS)), 3])]
    for row in rows:
        options = [t or "" for i, t in [*enumerate(TEXTS), (3, TEXTS[8]), (None, "no id")] if i == row["doc_id"]]
        assert row["ids"] in [[*library.encode(t, add_special_tokens=False).ids, 1] for t in options]
    assert {r["doc_id"] for r in token_files.read_tokens(spark, path, [5, 7]).collect()} == {5, 7}
    empty = scratch_path(spark, "tokens")
    token_files.write_tokens(texts.limit(0), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_tokens(spark, empty).count() == 0


def test_marks_behind_words_and_small_memos(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_ENTRIES", 40)
    monkeypatch.setattr(token_files, "CORE_ENTRIES", 40)
    monkeypatch.setattr(token_files, "JOINED", 7)
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as file:
        codec = token_files.WordCodec(file.read())
    draw = random.Random(21)
    words = ["Word", "it's", "don't", "niño", "été", "x1", "A.B", "क़", "'s", "<|endoftext|>", "ok<|endoftext|>", "n" * 90]
    marks = ["", ".", "...", "&&&", "***", "!?", "'", "'.", "_", "|>", ".s", "'s"]
    texts = [" ".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randint(0, 30))) for _ in range(600)]
    library = Tokenizer.from_file(path)
    expected = [found.ids for found in library.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(d, "<u4").tolist() for d in codec.encode(pa.array(texts))] == expected


def test_added_tokens_are_matched_in_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as file:
        codec = token_files.WordCodec(file.read())
    draw = random.Random(19)
    parts = ["<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|endof", "text|>", "A", "é", ".", ",", " ", "\n", "\t", "x" * 70]
    texts = ["<|endoftext|>.", "A<|endoftext|>b,", *("".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(2000))]
    for text, data in zip(texts, codec.encode(pa.array(texts)), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert 49407 in np.frombuffer(codec.encode(pa.array(["<|endoftext|>"]))[0], "<u4")


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("window", [10, 3])
def test_decontamination_equals_brute_force(spark, window):
    draw = random.Random(window)
    vocabulary = ["a", "B", "ç", "É", "x1", "日"]

    def text(n):
        return draw.choice([" ", ", ", "\n"]).join(draw.choice(vocabulary) for _ in range(n))

    items = [(i, text(draw.choice([0, 2, 4, 12]))) for i in range(8)] + [(3, text(11)), (None, "only words without id x1 x1 x1 x1 x1 x1"), (9, None)]
    docs = [(i, text(draw.randint(0, 40)), "x") for i in range(60)]
    docs += [(60, items[0][1], "x"), (61, None, "x"), (None, items[1][1], "x"), docs[4], docs[4]]
    documents = spark.createDataFrame(docs, "doc_id long, text string, words string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for doc_id, value, _ in docs:
        have, hit, named = words(value), set(), set()
        any_hit = False
        for item, passage in items:
            w = words(passage)
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                for at in range(len(have) - n + 1):
                    if have[at:at + n] == w[i:i + n]:
                        hit |= set(range(at, at + n))
                        any_hit = True
                        if item is not None:
                            named.add(str(item))
        listed = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        expected.append((doc_id, len(have), len(hit), len(named), listed, any_hit))
    found = [tuple(r) for r in decontaminate.report(documents, benchmark, window=window).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(found, key=key) == sorted(expected, key=key)
    clean = decontaminate.remove_documents(documents, benchmark, window=window)
    assert clean.count() == sum(not e[-1] for e in expected) and clean.columns == documents.columns
    assert decontaminate.report(documents, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.report(documents.limit(0), benchmark).count() == 0


def test_registered_queries_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES["op1_pii"](spark, sf).columns[:3] == ["doc_id", "n_email", "n_ip"]
    assert queries.QUERIES["op8_decontamination"](spark, sf).filter(F.col("n_hit") > 0).count() >= 0


def test_letters_of_every_code_point_keep_their_marks():
    """A letter before a stop or comma, precomposed ones included, which NFC turns into letter and mark."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as file:
        codec = token_files.WordCodec(file.read())
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha() and not 0x4E00 <= c <= 0xD7A3]
    texts = ["x " + " ".join(f"{a}. b{a}, {a.upper()}c." for a in letters[n : n + 200]) for n in range(0, len(letters), 200)]
    for text, data in zip(texts, codec.encode(pa.array(texts)), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memo_generations_and_decoder(monkeypatch):
    """Small generations give the same ids; documents are decoded together and a long one in parts."""
    monkeypatch.setattr(bpe, "GENERATION", 5)
    monkeypatch.setattr(bpe, "DECODED", 7)
    with open(PATH, "rb") as file:
        ranks = bpe.parse_ranks(file.read())
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    decode = bpe.Decoder(ranks)
    draw = random.Random(23)
    for _ in range(300):
        text = " ".join(draw.choice(["the", "house", "maison,", "Größe.", "日本", "abcde" * 9]) for _ in range(draw.randint(0, 20)))
        ids = np.frombuffer(codec.encode(text), "<i4")
        assert ids.tolist() == known.encode_ordinary(text) and decode(ids) == text.encode()
        assert len(codec.memo) <= 5 and len(codec.memo.older) <= 5
    for wrong in (-1, 10**7, max(ranks.values()) + 1):
        with pytest.raises(KeyError):
            decode(np.array([wrong]))


def test_decode_of_empty_and_null_lists(spark):
    rows = [(0, [5, 6]), (1, []), (2, None), (3, list(range(40)) * 9), (4, [7])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    with open(PATH, "rb") as file:
        bytes_of = {r: b for b, r in bpe.parse_ranks(file.read()).items()}
    found = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(df, PATH).collect()}
    assert found == {i: b"".join(bytes_of[t] for t in ids or []) for i, ids in rows}


def test_language_starts_in_a_plain_session(tmp_path):
    """As the first query of a session started elsewhere, whose workers do not know the package."""
    script = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('rows', e.queries()['op10_language'](spark, '/root/testdata/sf0.001').count())\n"
    )
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script, here], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=600
    )
    assert "rows 200" in done.stdout, done.stderr[-2000:]


def test_words_are_looked_up_once_a_group(monkeypatch):
    """A word goes through Python once for each group of texts, whatever the number of texts, and ids are the library's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as file:
        codec = token_files.WordCodec(file.read())
    asked = []
    learn = codec._learn
    monkeypatch.setattr(codec, "_learn", lambda words: asked.append(len(words)) or learn(words))
    draw = random.Random(29)
    words = ["Été,", "été", "naïve.", "THE", "the;", "İx", "x" * 80, "3.", "́.", "日本。", "", "\t", "a\nb", "<|endoftext|>É,"]
    texts = [None, "", " ", *(" ".join(draw.choice(words) for _ in range(draw.randint(0, 9))) for _ in range(2000))]
    for bytes_a_group, groups in ((8 << 20, 1), (1, len(texts))):
        monkeypatch.setattr(token_files, "GROUP_BYTES", bytes_a_group)
        asked.clear()
        for part in (pa.array(texts), pa.array(["left out", *texts]).slice(1)):
            for text, data in zip(texts, codec.encode(part), strict=True):
                assert np.frombuffer(data, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
        assert sum(asked[: len(asked) // 2]) < 60 or bytes_a_group == 1
        assert len(asked) <= 2 * groups
    assert not [word for word in codec.cores.young if len(word) > token_files.MEMO_LENGTH]
