"""Token-id files of directly addressable codes.

An id is split into 8-bit chunks. Level k holds the k-th chunk of each id that
has one, a continuation bitmap says which ids go on, and a rank directory (ones
before every 512th bit) leads to their places on the next level. So any token is
read by a few array accesses, and a document's ids are one contiguous range on
every level; nothing else is decoded.

Texts are tokenised where they are read and never shuffled. The ends of even ranges
of document ids (null ids last; rows of equal id by their text's hash) are found
from ids and hashes alone; the token ids, 16 bits each where the vocabulary allows,
are then dealt to their range by one shuffle, sorted and written as Parquet rows that each hold one file of about `file_tokens` ids: the codes, the documents'
ids and their ends. The codes are stored uncompressed, a file to a page, so a
lookup reads one file's bytes as they are. A document is never split over files,
so a file is larger than `file_tokens` only by its last document.

Defined results: a null or empty text has the end id only. Repeated rows are
documents of their own. An empty table gives no files and no rows. Only the id
and text columns are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zephyrframe.llm.common import kept, scratch_path
from zephyrframe.llm.token_count import byte_symbols

MAGIC = b"DAC1"
BLOCK = 512


def encode(ids: np.ndarray) -> bytes:
    """Ids (up to 32 bits) as directly addressable codes."""
    rest, parts = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        padded = np.zeros(-(-max(len(rest), 1) // BLOCK) * BLOCK, bool)
        padded[: len(more)] = more
        ones = padded.reshape(-1, BLOCK).sum(axis=1)
        directory = np.concatenate(([0], np.cumsum(ones))).astype("<u8")
        parts.append(struct.pack("<QQ", len(rest), len(directory)) + (rest & 0xFF).astype(np.uint8).tobytes() + np.packbits(padded, bitorder="little").tobytes() + directory.tobytes())
        if not more.any():
            return MAGIC + struct.pack("<B", len(parts)) + b"".join(parts)
        rest = rest[more] >> 8


class Codes:
    """Reads a file of directly addressable codes."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.levels, at = [], 5
        for _ in range(content[4]):
            n, entries = struct.unpack_from("<QQ", content, at)
            chunks = np.frombuffer(content, np.uint8, n, at + 16)
            bits = np.frombuffer(content, np.uint8, (entries - 1) * BLOCK // 8, at + 16 + n)
            directory = np.frombuffer(content, "<u8", entries, at + 16 + n + len(bits))
            self.levels.append((chunks, bits, directory))
            at += 16 + n + len(bits) + 8 * entries

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def rank(level: tuple, at: int) -> int:
        """Ids before place `at` that go on to the next level."""
        _, bits, directory = level
        block = at // BLOCK
        before = int(directory[block])
        inside = bits[block * BLOCK // 8 : at // 8]
        before += int(np.bitwise_count(inside).sum())
        return before + (int(bits[at // 8] & ((1 << at % 8) - 1)).bit_count() if at % 8 else 0)

    def __getitem__(self, at: int) -> int:
        """One id, by a few accesses a level."""
        if not 0 <= at < len(self):
            raise IndexError(at)
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level[0][at]) << 8 * k
            if not level[1][at // 8] >> at % 8 & 1:
                break
            at = self.rank(level, at)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids from start to end (exclusive); on each level they are one range."""
        out, where = np.zeros(end - start, np.uint32), np.arange(end - start)
        for k, level in enumerate(self.levels):
            if start >= end:
                break
            chunks, bits, _ = level
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            first = start // 8
            more = np.unpackbits(bits[first : -(-end // 8)], bitorder="little")[start - 8 * first : end - 8 * first].astype(bool)
            start, end = self.rank(level, start), self.rank(level, start) + int(more.sum())
            where = where[more]
        return out


#: Latin-1 letters in lower case, and ASCII punctuation but the apostrophe, which contractions use.
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
MARKS = "!-&(-/:-@\\[-`{-~"
#: The rules of a vocabulary file under which white space separates tokens for good and pieces can be named beforehand.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def known_rules(spec: dict) -> bool:
    """Whether a vocabulary file has the rules above, and special strings that begin with "<|" and stand for themselves."""
    plain = all(t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    model = spec["model"]
    chance = model.get("dropout") or model.get("fuse_unk") or model.get("continuing_subword_prefix")
    return spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER and plain and not chance and not (spec.get("truncation") or spec.get("padding"))


class WordEncoder:
    """Ids of whole texts from the tokenizers library.

    Under the rules above (`known_rules`) a text is its white-space chunks, and in
    plain Latin-1 texts a chunk is runs of letters, single digits and runs of
    punctuation, which such a tokenizer always splits. The library's model encodes
    each piece once; ids of pieces and chunks are kept, up to a bounded number of
    those seen first. Past it, new ones are encoded for their batch only. Under
    any other rules the library encodes every whole text.
    """

    def __init__(self, spec: str, cache: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = known_rules(json.loads(spec))
        self.model = self.tokenizer.model
        self.cache = cache
        #: Ids by chunk of plain texts (Latin-1, lower case), by piece of them, and by chunk of other texts (UTF-8).
        self.chunks: dict[bytes, bytes] = {}
        self.runs: dict[bytes, bytes] = {}
        self.others: dict[bytes, bytes] = {}
        letters, marks = LETTERS.encode("latin-1"), MARKS.encode("latin-1")
        self.split = re.compile(b"[" + letters + b"]+|[0-9]|[" + marks + b"]+").findall
        plain = re.compile(b"[" + letters + marks + b"0-9 \n]")
        self.plain = bytes(b for b in range(256) if plain.match(bytes([b])))
        self.symbols = dict(enumerate(byte_symbols()))
        #: Bytes of an id: two where every id fits.
        self.kind = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"

    def words(self, text: str) -> tuple[list[bytes], bool]:
        """The chunks of a text, and whether it is plain."""
        if "<|" not in text:
            try:
                raw = text.lower().encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                if not raw.translate(None, self.plain):
                    return raw.split(), True
        return text.encode().split(), False

    def learn_plain(self, new: set[bytes]) -> list[bytes]:
        """Keep the ids of plain chunks; returns the new pieces."""
        runs, tokenize, pack, fresh = self.runs, self.model.tokenize, struct.pack, []
        for chunk in new:
            parts = self.split(chunk)
            for part in parts:
                if part not in runs:
                    # The model takes a piece by its bytes' symbols; those of ASCII marks and letters are themselves.
                    piece = part.decode("latin-1")
                    ids = [t.id for t in tokenize(piece if part.isascii() else piece.encode().decode("latin-1").translate(self.symbols))]
                    runs[part] = pack(f"<{len(ids)}{self.kind}", *ids)
                    fresh.append(part)
            self.chunks[chunk] = runs[parts[0]] if len(parts) == 1 else b"".join(map(runs.__getitem__, parts))
        return fresh

    def learn_others(self, new: set[bytes]) -> None:
        """Keep the ids of other chunks."""
        listed = list(new)
        for w, e in zip(listed, self.tokenizer.encode_batch_fast([w.decode() for w in listed], add_special_tokens=False)):
            self.others[w] = struct.pack(f"<{len(e.ids)}{self.kind}", *e.ids)

    def __call__(self, texts: list[str], end_id: int) -> list[bytes]:
        """For each text its ids and the end id as little-endian integers of `kind`."""
        end = struct.pack("<" + self.kind, end_id)
        if not self.known:
            return [struct.pack(f"<{len(e.ids)}{self.kind}", *e.ids) + end for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [self.words(t) for t in texts]
        new_plain = {w for words, plain in split if plain for w in words}.difference(self.chunks)
        new_others = {w for words, plain in split if not plain for w in words}.difference(self.others)
        new_runs = self.learn_plain(new_plain)
        if new_others:
            self.learn_others(new_others)
        out = [b"".join([*map((self.chunks if plain else self.others).__getitem__, words), end]) for words, plain in split]
        for held, new in ((self.chunks, new_plain), (self.runs, new_runs), (self.others, new_others)):
            if len(held) > self.cache:
                for w in new:
                    del held[w]
        return out


def _encode_batches(spec, ends: list[tuple], end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A worker that runs several tasks goes on with the pieces it knows.
    encoder = kept("WordEncoder", zlib.crc32(spec.value.encode()), lambda: WordEncoder(spec.value))
    width = struct.calcsize("<" + encoder.kind)
    names = ["id", "digest", "part", "width", "tokens"]
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            some = batch.slice(at, 128)
            parts = [bisect_left(ends, (k is None, k, h)) for k, h in zip(some.column(0).to_pylist(), some.column(1).to_pylist())]
            coded = encoder([v.as_py() or "" for v in some.column(2)], end_id)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(parts, pa.int32()), pa.array([width] * len(coded), pa.int32()), pa.array(coded, pa.binary())], names)


def _file_batches(file_tokens: int, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, start, size, last = [], 0, 0, None
    names = ["part", "start", "n_tokens", "ids", "ends", "codes"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary()]

    def file() -> pa.RecordBatch:
        nonlocal held, start, size
        ids = np.concatenate([x[2] for x in held])
        ends = np.cumsum([len(x[2]) for x in held])
        out = [[held[0][1]], [start], [len(ids)], [[x[0] for x in held]], [ends.tolist()], [encode(ids)]]
        held, start, size = [], start + len(ids), 0
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

    for batch in batches:
        for key, part, width, raw in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist(), batch.column("width").to_pylist(), batch.column("tokens")):
            if held and held[0][1] != part:
                yield file()
            start = start if part == last else 0
            last = part
            ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
            held.append((key, part, ids))
            size += len(ids)
            if size >= file_tokens:
                yield file()
    if held:
        yield file()


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, file_tokens: int = 1_000_000) -> None:
    """Tokenise whole texts and write the files below `path` (any path that Spark writes)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType
    arrow, named = to_arrow_type(kind), kind.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    keys = [F.col("id").asc_nulls_last(), F.col("digest")]
    # One range end for each shuffle partition, whose number is a setting.
    ranged = rows.select("id", "digest").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    last = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("last"))
    ends = sorted(tuple(r["last"]) for r in last.collect())
    coded = rows.mapInArrow(lambda batches: _encode_batches(spec, ends, end_id, batches), f"id {named}, digest long, part int, width int, tokens binary")
    dealt = coded.repartitionById(max(1, len(ends)), "part").sortWithinPartitions("part", *keys).select("id", "width", "tokens", "part")
    files = dealt.mapInArrow(lambda batches: _file_batches(file_tokens, arrow, batches), f"part int, start long, n_tokens long, ids array<{named}>, ends array<long>, codes binary")
    # A page takes one file's codes, as they exceed a page's size, and holds them as they are.
    files.write.option("compression", "uncompressed").option("parquet.block.size", 16 << 20).parquet(path)


def bases(files: DataFrame) -> DataFrame:
    """part, base: the ids before each partition of the write; as many rows as it had partitions, which is a setting."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a place among all documents' ids, from the one stored file that holds it.

    The places of files are read alone; of the codes only that file's are read, and of them a few bytes a level.
    """
    files = spark.read.parquet(path)
    first = F.col("base") + F.col("start")
    places = files.select("part", "start", "n_tokens").join(F.broadcast(bases(files)), "part")
    found = places.filter((first <= position) & (F.lit(position) < first + F.col("n_tokens"))).select("part", "start", (F.lit(position) - first).alias("at")).first()
    if found is None:
        raise IndexError(position)
    content = files.filter((F.col("part") == found["part"]) & (F.col("start") == found["start"])).select("codes").first()[0]
    return Codes(content)[found["at"]]


def tokens_of(spark: SparkSession, path: str, ids: Sequence, id_col: str = "doc_id") -> DataFrame:
    """id, tokens of the named documents, read by range from the files that hold them."""
    from pyspark.sql.pandas.types import to_arrow_type

    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType
    arrow, wanted = to_arrow_type(kind), set(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held, ends, content = (batch.column(c)[k].as_py() for c in range(3))
                codes, found = Codes(content), [n for n, name in enumerate(held) if name in wanted]
                tokens = [codes.slice(ends[n - 1] if n else 0, ends[n]).tolist() for n in found]
                yield pa.RecordBatch.from_arrays([pa.array([held[n] for n in found], arrow), pa.array(tokens, pa.list_(pa.int64()))], ["id", "tokens"])

    some = files.filter(F.arrays_overlap("ids", F.array(*[F.lit(i).cast(kind) for i in wanted])))
    return some.select("ids", "ends", "codes").mapInArrow(run, f"id {kind.simpleString()}, tokens array<long>").withColumnRenamed("id", id_col)


def _read_batches(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            part, start, ids, ends, content = (batch.column(c)[k].as_py() for c in range(5))
            codes = Codes(content)
            starts = [0, *ends[:-1]]
            sums = [zlib.crc32(codes.slice(s, e).astype("<u4").tobytes()) for s, e in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array([part] * len(ids), pa.int32()), pa.array([start + s for s in starts], pa.int64()), pa.array([e - s for s, e in zip(starts, ends)], pa.int64()), pa.array(sums, pa.int64())],
                ["id", "part", "start_in_part", "n_tokens", "ids_crc32"],
            )


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """From the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    from pyspark.sql.pandas.types import to_arrow_type

    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType
    arrow = to_arrow_type(kind)
    rows = files.select("part", "start", "ids", "ends", "codes").mapInArrow(lambda batches: _read_batches(arrow, batches), f"id {kind.simpleString()}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases(files)), "part").select(F.col("id").alias(id_col), (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None, file_tokens: int = 1_000_000) -> DataFrame:
    """Write the files, then return the digests read back from them."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer_path, path, id_col, text_col, end_id, file_tokens)
    return read_digests(docs.sparkSession, path, id_col)
