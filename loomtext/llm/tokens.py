"""Token-id files: encode a corpus in key order into bit-packed shards and read them back.

Defined cases: a null or empty text is a document that holds only the end id; null
keys come first; repeated keys are kept, ordered by text; an empty table gives no
files and no rows; only the named columns are read, so extra columns don't matter.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack
from .store import delete, open_fs, scratch, shuffle_width, tune, worker_cache

#: Characters that are no Latin letters, digits or marks; Unicode's versions differ in the classes of some of them.
OTHER = "[^\x00-\u024f]"
#: Chunks held per worker before the older half is dropped.
HELD = 400_000
# Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for the characters from 256 on, in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class PieceEncoder:
    """Whole-text encoding by the tokenizers library, with each distinct chunk encoded once.

    A byte-level BPE never merges across the pieces of its pre-tokenizer, and a space or line feed
    between two characters that are no white space always starts a piece: the pattern's pieces hold
    white space at their start only, or are runs of it. A text is cut at such places alone. Every chunk
    goes to the library with what stands before it, and its ids are remembered; a chunk of Latin
    letters is one piece and goes straight to the library's model. White space of any other kind
    or length stays inside a chunk. Texts with special tokens go to the library whole, and so
    does everything if the tokenizer isn't of this kind.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        plain = plain and model.get("type") == "BPE" and not model.get("dropout") and not model.get("unk_token") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        self.plain = plain
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        # Python's white space has all of the pattern's and a few separators more, next to which a text isn't cut.
        self.odd = [*(a + b for a in " \n" for b in " \n"), *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
        self.cut = re.compile(r"(?<=\S)(?=[ \n]\S)").split
        self.other = re.compile(OTHER).search
        self.model = self.tokenizer.model
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = {c: self.whole(c) for c in ",.;:!?\n"}

    @property
    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def whole(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, by the library as it is."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The same ids, chunk by chunk."""
        if not self.plain or any(x in text for x in self.special):
            return self.whole(text)
        if text[:1] in " \n" or text[-1:] in " \n" or any(x in text for x in self.odd):
            head, *rest = self.cut(text)
            rest = [c[1:] if c[0] == " " else c for c in rest]
        else:
            head, *rest = text.replace("\n", " \n").split(" ")
        get, other = self.new.get, self._chunk
        return self.whole(head) + b"".join([get(c) or other(c) for c in rest])

    def _letters(self, piece: str) -> bytes:
        """Ids of a piece of Latin letters, with a space before it or none, by the library's model."""
        spelled = piece.replace(" ", BYTE_CHARS[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [x.id for x in self.model.tokenize(spelled)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk with the space before it, or with the line feed that it starts with."""
        if len(self.new) > HELD:
            # The dictionary stays the same object: ``encode`` holds on to its methods.
            self.old = dict(self.new)
            self.new.clear()
        got = self.old.get(chunk)
        if got is None:
            if chunk.isalpha() and not self.other(chunk):
                got = self._letters(" " + chunk)
            elif chunk[-1] in ",.;:!?" and chunk[:-1].isalpha() and not self.other(chunk):
                # Letters are one piece, and what is neither letter, number nor white space is the next.
                got = (self.new.get(chunk[:-1]) or self._chunk(chunk[:-1])) + self.marks[chunk[-1]]
            elif chunk[0] == "\n":
                # A single line feed before something else is a piece.
                rest = chunk[1:]
                got = self.marks["\n"] + (self._letters(rest) if rest.isalpha() and not self.other(rest) else self.whole(rest))
            else:
                got = self.whole(" " + chunk)
        self.new[chunk] = got
        return got


def _encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_cache(f"pieces_{zlib.crc32(path.encode())}", lambda: PieceEncoder(path))


def write_shards(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encode ``docs`` in ascending ``key`` order into files below ``out_dir``; returns the written manifest.

    One range partition makes one file, so nothing but the manifest's few numbers per file is
    ever gathered. Attempts write to names of their own and only files named by the manifest
    count, so a task that is run again leaves no double.
    """
    spark = docs.sparkSession
    tune(spark)
    n = shards or shuffle_width(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fs = path = sink = writer = None
        encoder, end = _encoder(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            for k, t in zip(batch["k"].tolist(), batch["t"].tolist(), strict=True):
                if writer is None:
                    fs, root = open_fs(out_dir)
                    fs.create_dir(root)
                    path = f"{root}/{uuid.uuid4().hex}.ltok"
                    sink = fs.open_output_stream(path, compression=None)
                    writer = bitpack.Writer(sink, encoder.vocab_size)
                writer.add(None if k == "" else int(k), np.concatenate([np.frombuffer(encoder.encode(t), "<u4"), end]))
        if writer is not None:
            got = writer.close()
            sink.close()
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "file": [path.rsplit("/", 1)[1]], "n_docs": [got["n_docs"]], "n_ids": [got["n_ids"]]})

    rows = docs.select(F.col(key).cast("long").alias("o"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(n, "o").sortWithinPartitions(F.asc_nulls_first("o"), "t")
    made = rows.select(F.coalesce(F.col("o").cast("string"), F.lit("")).alias("k"), "t").mapInPandas(write, "part int, file string, n_docs long, n_ids long")
    made.write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(made.schema).parquet(f"{out_dir}/manifest")


def read_shards(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per document of the files: key, start (ids before it in the whole corpus), ids' count and crc32, file."""
    manifest = spark.read.parquet(f"{out_dir}/manifest").orderBy("part").collect()  # one row for each file
    starts, total = [], 0
    for m in manifest:
        starts.append((m.part, m.file, total))
        total += m.n_ids
    files = spark.createDataFrame(starts, "part int, file string, base long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, base in zip(batch["file"], batch["base"], strict=True):
                fs, root = open_fs(out_dir)
                with fs.open_input_file(f"{root}/{file}") as source:
                    reader = bitpack.Reader(source)
                    n = reader.meta["n_docs"]
                    for lo in range(0, n, 4096):
                        hi = min(n, lo + 4096)
                        crc = [zlib.crc32(np.ascontiguousarray(reader.document(i), "<u4").tobytes()) for i in range(lo, hi)]
                        ends = reader.ends[lo:hi].astype(np.int64)
                        first = np.concatenate([[int(reader.ends[lo - 1]) if lo else 0], ends[:-1]]).astype(np.int64)
                        keys = pd.array(reader.keys[lo:hi].astype(np.int64), dtype="Int64")
                        keys[reader.null[lo:hi].astype(bool)] = pd.NA
                        yield pd.DataFrame({"key": keys, "start": first + base, "n_tokens": ends - first, "ids_crc32": np.array(crc, np.int64), "file": file})

    return files.repartition(max(1, len(starts)), "part").mapInPandas(read, "key long, start long, n_tokens long, ids_crc32 long, file string")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", out_dir: str | None = None) -> DataFrame:
    """:func:`write_shards` and then :func:`read_shards`."""
    spark = docs.sparkSession
    out = out_dir or scratch(spark, "tokens")
    write_shards(docs, out, tokenizer, end_id, key, text)
    return read_shards(spark, out)


def drop_shards(spark: SparkSession, out_dir: str) -> None:
    delete(spark, out_dir)
