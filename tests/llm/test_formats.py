"""WARC bundles and token files: exact round trips."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import bitpack, tokens, warc

from .conftest import prose

public_tokenizers = pytest.importorskip("public_tokenizers")


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 24, 31])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1003).astype(np.uint32)
    data = bitpack.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8)
    assert (bitpack.unpack(data, 1003, bits) == ids).all()
    assert (bitpack.unpack(data, 10, bits, 500) == ids[500:510]).all()


def test_file_gives_any_document_and_range():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (0, 1, 700, 3, 5000, 1)]
    sink = io.BytesIO()
    w = bitpack.Writer(sink, 50257, block_ids=512)
    for i, d in enumerate(docs):
        w.add(None if i == 3 else i, d)
    w.close()
    r = bitpack.Reader(Source(sink.getvalue()))
    assert r.meta["bits"] == 16 and r.null.tolist() == [0, 0, 0, 1, 0, 0]
    assert all((r.document(i) == d).all() for i, d in enumerate(docs))
    assert (r.ids(600, 1300) == np.concatenate(docs)[600:1300]).all()
    with pytest.raises(ValueError):
        bitpack.Reader(Source(sink.getvalue()[:-3]))


#: Every White_Space character, the separators that only some engines count, controls, and some neighbours.
BLANKS = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
CONTROLS = [chr(c) for c in (*range(0, 9), *range(14, 28), *range(127, 160)) if c != 0x85]
WORDS = ["don't", "we've", "'S", "'s", "'", "12a", "é", "Ñ,", "ñandú", "中文", "ok.", "a.b", "x_y", "…", "“q”", "²", "ª", "Ⅷ", "٣", "ไทย", "हिन्दी", "👍🏽", "e\u0301", "ß!", "A", "the", "\U0001e030", "\u0378", "\u1c89"]


def test_chunks_give_the_library_s_ids():
    e = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.plain
    rnd = random.Random(1)
    check = lambda t: e.encode(t) == e.whole(t) or pytest.fail(repr(t))
    for a in ["", "x", "é", ".", "1", "中"]:
        for b in [*BLANKS, *CONTROLS]:
            for c in [" ", "\n", b, ""]:
                for d in ["", "y", "'s", "!", "7", " "]:
                    check(a + b + c + d)
                    check(f"k {a}{c}{b}{d}")
    for k in range(60_000):
        kinds = [WORDS, BLANKS, [" ", "\n"], CONTROLS if k % 3 else ["<|endoftext|>"] if k % 30 == 0 else WORDS]
        check("".join(rnd.choice(rnd.choices(kinds, [5, 1, 4, 1])[0]) for _ in range(rnd.randint(0, 12))))
    for _ in range(30_000):
        check("".join(rnd.choices("ab  \n\t.é'\xa0s1", k=rnd.randint(0, 14))))
    e.new.clear()
    e.old = {}


def test_forgotten_chunks_are_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 50)
    e = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(2)
    for _ in range(50):
        t = prose(rnd, 60, 300)
        assert e.encode(t) == e.whole(t) and len(e.new) <= 52


def test_token_files(spark, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokens.write_and_read(odd_docs, path).orderBy("start").collect()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    docs = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for g, d in zip(got, docs, strict=True):
        ids = [*tk.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (g.key, g.start, g.n_tokens, g.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.write_and_read(no_docs, path).count() == 0


def test_bundle_is_a_seekable_zstandard_stream():
    import zstandard

    sink = io.BytesIO()
    w = warc.BundleWriter(sink, frame_bytes=3000)
    records = {warc.record_id(i): warc.record(i, f"http://x/{i}", b"p" * i * 50, warc.digest(b"p" * i * 50), None, False, "2020-01-01T00:00:00Z") for i in range(60)}
    for k, v in records.items():
        w.add(k, v)
    w.close()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(records.values())
    r = warc.BundleReader(Source(sink.getvalue()))
    assert len(r.frames) > 5
    head, block = r.record(warc.record_id(37))
    assert head["WARC-Target-URI"] == "http://x/37" and block.endswith(b"p" * 1850)


def test_archives(spark):
    rows = [(3, "http://a/ü\r\nX: y", "same"), (1, None, "same"), (2, "u", "same"), (1, "u", "same"), (None, "u", "same"), (7, "", None), (6, "u", ""), (9, "u", "long " * 300000), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1)).withColumn("first", F.lit(2))
    got = warc.archive_and_read(pages).select(warc.key_of(F.col("record_id")).alias("k"), "record_type", warc.key_of(F.col("refers_to")).alias("r"), "payload_bytes", "payload", "payload_digest").collect()
    assert len(got) == len(rows)
    seen = sorted((r.k is None, r.k or 0, r.record_type, r.r or 0, r.payload_bytes) for r in got)
    assert seen == sorted([(False, 1, "response", 0, 4)] * 2 + [(False, 2, "revisit", 1, 4), (False, 3, "revisit", 1, 4), (True, 0, "revisit", 1, 4), (False, 6, "response", 0, 0), (False, 7, "revisit", 6, 0), (False, 9, "response", 0, 1500000), (True, 0, "response", 0, 5)])
    assert all(bytes(r.payload) == (b"" if r.record_type == "revisit" else bytes(r.payload)) for r in got)
    assert warc.archive_and_read(pages.limit(0)).count() == 0
    big = warc.archive_and_read(pages, min_revisit_bytes=5)
    assert big.where("record_type = 'revisit'").count() == 0
