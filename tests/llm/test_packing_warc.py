import gzip
import hashlib
import io
import os
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import common, packing, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, ids string"
TEXTS = ["it's Straße ΣΑΣ İx 日本語 don't 12³ ½ x y é ﬁ \x1c \x85 q", "", "  \n\t ", "a" * 5000, "<|endoftext|> b<|startoftext|>c", "Hello, World!! ...%%% A1b2", "word " * 30_000]


def test_cached_tokenizer_equals_tokenizers(monkeypatch):
    t, mine = Tokenizer.from_file(PATH), packing.CachedTokenizer(PATH)
    assert mine.plain.pattern != "(?!)"
    want = [t.encode(x, add_special_tokens=False).ids for x in TEXTS]
    assert [x.tolist() for x in mine.encode_batch(TEXTS)] == want
    monkeypatch.setattr(packing, "WORDS", 3)
    assert [x.tolist() for x in mine.encode_batch(TEXTS * 100)] == want * 100


def checked(rows, texts, size):
    """Every id in one piece, sequences gapless and full or of a power of two; gives the number of sequences."""
    t = Tokenizer.from_file(PATH)
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_seq.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end and n > 0
            end += n
        assert end <= size and (end == size or end & (end - 1) == 0)
    for doc, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.ids == part.tolist()
    return len(by_seq)


@pytest.mark.parametrize("most_open", [packing.OPEN, 3])
def test_packing_edge_cases(spark, monkeypatch, most_open):
    monkeypatch.setattr(packing.Packer.__init__, "__defaults__", (most_open,))
    texts = dict(enumerate([*TEXTS, None, *(f"text {i} " * (i % 50) for i in range(200))]))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts.items()], DOCS).coalesce(1)
    n = checked(packing.pack(df, PATH, 512).collect(), texts, 512)
    total = sum(r.length for r in packing.pack(df, PATH, 512).collect())
    assert n <= total // 512 + 10
    assert packing.pack(df.where("false"), PATH).collect() == []
    again = packing.pack(df.union(df.limit(1)), PATH, 512, with_ids=False)
    assert "ids" not in again.columns and again.where("doc_id = 0").count() >= 2


def test_sum_of_squares_places_as_by_definition():
    rng, size, seen = np.random.default_rng(0), 64, []
    p = packing.Packer(size, lambda k, pieces: seen.append(sum(len(x[2]) for x in pieces)), 10_000)
    for n in rng.integers(1, 64, 300).tolist():
        count = p.count.copy()
        options = {}
        for h in range(size - n + 1):
            if h == 0 or count[h]:
                after = count.copy()
                after[h] -= h > 0
                after[h + n] += h + n < size
                options[h] = int((after**2).sum())
        p.add(0, np.zeros(n, "<u4"))
        after = p.count.copy()
        assert int((after**2).sum()) == min(options.values())
    p.finish()
    assert all(x == size or x & (x - 1) == 0 for x in seen)


PAGES = "page_id long, url string, html string, extra string"
BIG = "<p>" + "é" * 60 + "</p>"
ROWS = [(5, "http://a/5", BIG), (2, "http://a/2\r\nX: y", BIG), (9, None, BIG), (1, "u", None), (3, "u", ""), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "x" * 100), (8, "u", "x" * 100), (9, None, BIG), (None, "u", BIG), (None, "v", "y" * 200), (10, "u", "z" * 300_000), (11, "u", "WARC/1.1\r\n\r\n\x1f\r\n" * 30)]


@pytest.mark.parametrize("byte_range", [warc.RANGE, 100])
def test_round_trip(spark, byte_range):
    df = spark.createDataFrame([(*r, "e") for r in ROWS], PAGES).withColumnRenamed("extra", "digest").repartition(3)
    low = {}
    for i, _, h in ROWS:
        if i is not None:
            low[h] = min(low.get(h, i), i)
    want = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        again = len(b) >= 100 and low.get(h) is not None and i != low[h]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low[h] if again else None))
    got = [tuple(r) for r in warc.warc_round_trip(df, byte_range).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.warc_round_trip(df.where("false")).collect() == []


def test_reader_owns_each_record_once_and_survives_false_magic():
    payloads = [os.urandom(40) + warc.MAGIC * 5 + gzip.compress(b"no record") + os.urandom(n) for n in (0, 3000, 70_000, 5)]
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(p) + p + b"\r\n\r\n" for p in payloads]
    stored = [zlib.compressobj(0, zlib.DEFLATED, 31) for _ in records]  # stored blocks keep the magic visible
    data = b"".join(z.compress(r) + z.flush() for z, r in zip(stored, records, strict=True))
    whole = [r for _, r in warc.members(io.BytesIO(data), 0, len(data))]
    assert whole[0] == records[0]
    for step in (7, 1000, 50_000):
        found = [m for s in range(0, len(data), step) for m in warc.members(io.BytesIO(data), s, min(len(data), s + step))]
        assert sorted(set(found)) == sorted(found) and [r for _, r in sorted(found)] == records
    assert [p for _, p in warc.records(records[1])] == [payloads[1]]
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(data[:-9]), 0, len(data)))


def plain(payload, kind="response"):
    return b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), len(payload), payload)


def gzip_member(content, name=b"", extra=b""):
    """A member with a file name and an extra field in its header."""
    flags = (8 if name else 0) | (4 if extra else 0)
    head = b"\x1f\x8b\x08" + bytes([flags]) + bytes(6) + (len(extra).to_bytes(2, "little") + extra if extra else b"") + (name + b"\0" if name else b"")
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return head + z.compress(content) + z.flush() + zlib.crc32(content).to_bytes(4, "little") + len(content).to_bytes(4, "little")


@pytest.mark.parametrize("name, extra", [(b"n" * 600, b""), (b"", b"\x1f\x8b\x08" * 200), (b"n" * 5000, b"e" * 60_000)])
def test_headers_of_any_length(name, extra):
    data = gzip_member(plain(b"one"), name, extra) + gzip_member(plain(b"two"))
    for step in (len(data), 500):
        got = [p for s in range(0, len(data), step) for _, c in warc.members(io.BytesIO(data), s, min(len(data), s + step)) for _, p in warc.records(c)]
        assert got == [b"one", b"two"]


def test_several_records_in_a_member_and_blank_lines_before():
    content = b"\r\n\r\n" + plain(b"a" * 50) + b"\n" + plain(b"", "metadata") + plain(b"WARC/1.0\r\n\r\n")
    [(at, got)] = warc.members(io.BytesIO(b"junk" + gzip_member(content)), 0, 10_000)
    assert at == 4 and [(h["warc-type"], p) for h, p in warc.records(got)] == [("response", b"a" * 50), ("metadata", b""), ("response", b"WARC/1.0\r\n\r\n")]
    with pytest.raises(ValueError, match="no record"):
        list(warc.records(plain(b"a") + b"rest"))


def test_reading_is_linear_in_the_members_of_a_block():
    data = gzip_member(plain(b"x")) * 20_000
    began = time.perf_counter()
    assert sum(1 for _ in warc.members(io.BytesIO(data), 0, len(data))) == 20_000
    assert time.perf_counter() - began < 10


def test_archives_of_another_file_system_and_without_a_broadcast(spark, tmp_path, monkeypatch):
    """URIs that only the given function can open, on the tasks too."""
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    base = str(tmp_path)

    def locate(uri):
        from pyarrow import fs

        assert uri.startswith("store://bucket/")
        return fs.SubTreeFileSystem(base, fs.LocalFileSystem()), uri.removeprefix("store://bucket/")

    df = spark.createDataFrame([(*r, "e") for r in ROWS], PAGES).repartition(3)
    manifest = warc.write_warc(df, "store://bucket/in/here", locate)
    assert all(r.path.startswith("store://bucket/in/here/part-") for r in manifest.collect())
    got = warc.read_warc(manifest, 1000, locate).collect()
    assert len(got) == len(ROWS) and {r.url for r in got if r.record_type == "revisit"} == {"http://a/5", "", "u"}
    assert {r.payload_digest for r in got if r.page_id == 7} == {hashlib.sha256(b"x" * 100).hexdigest()}


def test_uris_keep_their_file_system(tmp_path):
    fs, path = warc.located(f"file://{tmp_path}/ab")
    assert fs.type_name == "local" and path == f"{tmp_path}/ab"
    assert warc.located(str(tmp_path))[1] == str(tmp_path)
