"""Operator 1, token-id output: canonical length-limited Huffman coding of ids from global counts.

The format is a table of blocks and a table of codes, both Parquet in the shared
folder. A block is independent: a header, the documents' ids and token counts,
the bit offset of every ``STRIDE``-th token (the checkpoints), then the bits. It
holds whole documents, about ``BLOCK_TOKENS`` tokens or one longer document.
Code lengths are limited by package-merge, codes are canonical, and a reader
needs the code lengths alone. Decoding looks up whole codes in a table, from all
checkpoints of a block at once.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, one_batch, removed, table, task_partition, tune, written

END_ID = 1
STRIDE, BLOCK_TOKENS = 128, 1 << 18
MAGIC = b"HUFB\x01"
#: Distinct words, and runs of letters, whose ids a worker remembers in a generation.
CACHE = 300_000
#: Marks that often follow a word, and aren't letters, digits or white space.
MARKS = b".,;:!?*&%$#"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Length of each symbol's code, 0 for a count of 0: the least total length with none above ``limit`` (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, packed = leaves, []
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        rank = np.argsort(merged, kind="stable")
        packed.append(rank >= n)
        level = merged[rank]
    take, depth = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_package in reversed(packed):
        packages = int(is_package[:take].sum())
        depth[: take - packages] += 1
        take = 2 * packages
    depth[:take] += 1
    out[order] = depth
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        size = lengths[order].astype(np.uint64)
        top = int(size[-1])
        step = np.uint64(1) << (np.uint64(top) - size)
        codes[order] = (np.cumsum(step) - step) >> (np.uint64(top) - size)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, length) for every value of the next ``width`` bits."""
    width = max(1, int(lengths.max(initial=0)))
    symbol, size = np.zeros(1 << width, dtype=np.uint32), np.ones(1 << width, dtype=np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (width - lengths[order].astype(np.int64))
    filled = int(span.sum())
    symbol[:filled], size[:filled] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbol, size, width


def encode_block(ids: np.ndarray, doc_ids: list, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    bits = int(end[-1]) if len(end) else 0
    words = np.zeros(bits // 32 + 2, dtype=np.uint64)
    value = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
    for part, shift in ((value >> np.uint64(32), 0), (value & np.uint64(0xFFFFFFFF), 1)):
        words += np.bincount((at >> 5) + shift, weights=part.astype(np.float64), minlength=len(words)).astype(np.uint64)
    points = at[::STRIDE].astype("<u8")
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([d or 0 for d in doc_ids], dtype="<i8")
    head = MAGIC + struct.pack("<IQQI", len(doc_ids), len(ids), bits, STRIDE)
    return head + known.tobytes() + names.tobytes() + sizes.astype("<u8").tobytes() + points.tobytes() + words.astype(">u4").tobytes()


def decode_block(block: bytes, look: tuple[np.ndarray, np.ndarray, int]) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, tokens of each, all ids) of a block, by the table of decode_table()."""
    if block[:5] != MAGIC:
        raise ValueError("not a block of this format")
    docs, n, bits, stride = struct.unpack_from("<IQQI", block, 5)
    at = 29
    known = np.frombuffer(block, np.uint8, docs, at)
    names = np.frombuffer(block, "<i8", docs, at := at + docs)
    sizes = np.frombuffer(block, "<u8", docs, at := at + 8 * docs).astype(np.int64)
    points = np.frombuffer(block, "<u8", -(-n // stride), at := at + 8 * docs).astype(np.int64)
    words = np.frombuffer(block, ">u4", -1, at + 8 * len(points)).astype(np.uint64)
    symbol, size, width = look
    pair = np.zeros(len(words), dtype=np.uint64)
    pair[:] = words << np.uint64(32)
    pair[:-1] |= words[1:]
    out = np.zeros((len(points), stride), dtype=np.uint32)
    place, last = points.copy(), len(pair) - 1
    for k in range(stride):
        word = pair[np.minimum(place >> 5, last)]
        code = ((word << (place & 31).astype(np.uint64)) >> np.uint64(64 - width)).astype(np.int64)
        out[:, k] = symbol[code]
        place += size[code]
    return [int(d) if k else None for d, k in zip(names, known)], sizes, out.reshape(-1)[:n]


class Memo(dict):
    """What a function gave for its last arguments: two generations of ``most`` each; long arguments aren't kept."""

    def __init__(self, make, most):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > 64:
                return got
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = got
        return got


class WordEncoder:
    """Encodes whole texts just as ``Tokenizer.encode(text, add_special_tokens=False)``, a white-space-delimited word at a time.

    Words of printable ASCII and Latin-1 go straight to the library's BPE model,
    as the normaliser does no more to them than lower-casing; all others, and what
    may hold a special token, go through the whole tokenizer. A tokenizer of
    another kind encodes whole texts only. Words and letter runs are remembered in
    two generations of bounded size.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.width = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        config = json.load(open(path, encoding="utf-8"))
        kinds = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
        split = [x for x in (config["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0]["behavior"] == "Removed" and split[0]["invert"] and not split[1]["use_regex"] and not split[1]["add_prefix_space"]
        if self.by_word:
            self.pieces = regex.compile(split[0]["pattern"]["Regex"]).findall
            self.plain = regex.compile(r"[\x21-\x3b\x3d-\x7e¡-¬®-ÿ]+").fullmatch  # neither < nor white space
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in shown]
            self.shown = dict(zip(shown, map(chr, shown))) | {b: chr(256 + k) for k, b in enumerate(hidden)}
            self.tokenize = self.whole.model.tokenize
            self.code = "H" if self.width == "<u2" else "I"
            self.known = Memo(self.word, CACHE)
            self.run = Memo(self.letters, CACHE)
            self.rest = Memo(self.piece, CACHE // 16)

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    def letters(self, run: bytes) -> bytes:
        """A run of lower-case letters: one piece, whose ids are remembered by its bytes."""
        if run.isascii():
            return array(self.code, [t.id for t in self.tokenize(run.decode())]).tobytes()
        return self.piece(run.decode())

    def word(self, word: bytes) -> bytes:
        core = word.rstrip(MARKS)
        if core.isalpha():  # ASCII letters, then marks that are one piece
            ids = self.run[core.lower()]
            return ids + self.rest[word[len(core) :].decode()] if len(core) < len(word) else ids
        text = core.decode("utf-8", "replace")
        if text.isalpha() and max(text) <= "ÿ":
            ids = self.run[text.lower().encode()]
            return ids + self.rest[word[len(core) :].decode()] if len(core) < len(word) else ids
        text = word.decode("utf-8", "replace")
        if self.plain(text):
            return b"".join(map(self.rest.__getitem__, self.pieces(text.lower())))
        return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned integers of ``width``."""
        if not self.by_word:
            return np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=self.width).tobytes()
        return b"".join(map(self.known.__getitem__, text.split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget() -> None:
    _encoders.clear()


def id_type(path: str) -> str:
    """Two bytes an id between the stages, if the vocabulary fits; what is written is Huffman codes."""
    return encoder(path).width


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, ids): ids of the whole text and the end id, as little-endian unsigned integers of id_type(); row tells repeated ids apart."""
    out = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        coder, row = encoder(path), task_partition() << 40
        encode, end = coder.encode, np.array([end_id], dtype=coder.width).tobytes()
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.arange(row, row + n)), pa.array([encode(t.as_py()) + end for t in b.column(1)], pa.binary())], schema=out)
            row += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of().alias("text")).mapInArrow(run, "doc_id long, row long, ids binary")


def id_counts(rows: DataFrame, width: str) -> np.ndarray:
    """How often each id occurs in all documents; as many rows as the vocabulary has."""
    out = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        forget()  # all texts are encoded: a worker needs what it remembers no more
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), width), minlength=len(total))
            got[: len(total)] += total
            total = got
        used = np.flatnonzero(total)
        yield one_batch(out, id=used, n=total[used])

    found = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r.id] = r.n
    return counts


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, tag: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """The two tables of the format: blocks (part, block, first: tokens before it in its part, tokens, bytes) in ascending doc_id order, and codes (id, length).

    ``docs`` (doc_id, text): nulls, repeated ids and empty tables as in token_output().
    """
    spark = docs.sparkSession
    tune(spark)
    rows = written(encoded(docs, path, end_id), f"{tag}-ids")
    width = id_type(path)
    counts = id_counts(rows, width)
    lengths = code_lengths(counts, max(16, int(np.count_nonzero(counts)).bit_length() + 1))
    codes = written(spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, length int").coalesce(1), f"{tag}-codes")
    sent = spark.sparkContext.broadcast(lengths)  # a byte for each id of the vocabulary
    out = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.binary())])

    def write(batches):
        size, part, block = sent.value, task_partition(), 0
        codes = canonical_codes(size)
        names, ids, held, first = [], [], 0, 0

        def put():
            sizes = np.array([len(x) for x in ids])
            return one_batch(out, part=[part], block=[block], first=[first], tokens=[held], bytes=[encode_block(np.concatenate(ids), names, sizes, size, codes)])

        for b in batches:
            for d, t in zip(b.column(0), b.column(1)):
                got = np.frombuffer(t.as_buffer(), width)
                if held and held + len(got) > BLOCK_TOKENS:
                    yield put()
                    names, ids, held, first, block = [], [], 0, first + held, block + 1
                names.append(d.as_py())
                ids.append(got)
                held += len(got)
        if names:
            yield put()

    order = ["doc_id", "row"]
    blocks = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(write, "part long, block long, first long, tokens long, bytes binary"), tag)
    removed(rows)
    return blocks, codes


def read_codes(codes: DataFrame) -> np.ndarray:
    """Length of each id's code, as the table of codes has it: a row for each id of the vocabulary at most."""
    found = codes.select("id", "length").collect()
    lengths = np.zeros(max((r.id for r in found), default=-1) + 1, dtype=np.uint8)
    for r in found:
        lengths[r.id] = r.length
    return lengths


def read_tokens(blocks: DataFrame, codes: DataFrame, what: str = "digest") -> DataFrame:
    """The documents of the format's two tables: doc_id, start (ids of all before it), n_tokens and ids_crc32, or with ``what="ids"`` the ids (array).

    Nothing but these tables is needed. A row for each document that was written,
    repeated and null ids included; empty tables give no rows.
    """
    spark = blocks.sparkSession
    lengths = read_codes(codes)
    before, total = {}, 0  # one number for each written part
    for part, n in sorted(blocks.groupBy("part").agg(F.sum("tokens")).collect()):
        before[part], total = total, total + n
    sent = spark.sparkContext.broadcast((lengths, before))
    last = ("ids", pa.list_(pa.int64())) if what == "ids" else ("ids_crc32", pa.int64())
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def read(batches):
        size, offsets = sent.value
        look = decode_table(size)
        for b in batches:
            for part, start, block in zip(*(b.column(k) for k in range(3))):
                names, sizes, ids = decode_block(block.as_py(), look)
                ends = np.cumsum(sizes)
                ids = ids.astype("<u4")
                cut = [ids[e - n : e] for e, n in zip(ends, sizes)]
                yield one_batch(out, **{"doc_id": names, "start": offsets[part.as_py()] + start.as_py() + ends - sizes, "n_tokens": sizes, last[0]: cut if what == "ids" else [zlib.crc32(c.tobytes()) for c in cut]})

    return blocks.select("part", "first", "bytes").mapInArrow(read, f"doc_id long, start long, n_tokens long, {'ids array<long>' if what == 'ids' else 'ids_crc32 long'}")


def token_output(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all whole texts of ``docs`` (doc_id, text) and reads the files back: doc_id, start, n_tokens, ids_crc32 for each row.

    A null or empty text has the end id alone. Null ids come first; rows that
    repeat an id are all written, in the order in which they were read. Other
    columns are ignored. No rows give no rows.
    """
    return read_tokens(*write_tokens(docs, path, end_id))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
