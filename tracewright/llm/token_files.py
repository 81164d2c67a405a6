"""Token-id output: documents become ids of a public tokenizer, packed with Simple-8b into block files.

Word layout (64 bits): the upper 4 bits select, the lower 60 bits hold ``COUNT[selector]`` ids of
``WIDTH[selector]`` bits each, first id in the lowest bits. Selector 0 is the escape: its 60 bits are unused and the
next word is one raw 64-bit id, so every unsigned 64-bit value can be coded. Selector 1 stands for 60 ids
of value 0. A block holds whole documents; its row in the file keeps the offset of its first id within the file,
the documents' ids and lengths, and the words, so that blocks decode on their own and in any order.

Files are Parquet tables of such rows (``part``, ``block``, ``first``, ``doc_ids``, ``lengths``, ``words``), because Spark
can write those to any store that executors share. ``part`` numbers ascend with doc_id.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordMemo, bound_batches, scratch, shuffle_partitions, slices, task_state, texts_of

WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNT = np.array([0, 60, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
ESCAPE = 0

BLOCK_SCHEMA = "part int, block int, first long, doc_ids array<long>, lengths array<long>, n_ids long, words binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("words", pa.binary())])


def pack(ids: np.ndarray) -> bytes:
    """Simple-8b words of unsigned 64-bit ids: at each place the selector that takes the most ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return b""
    if ids.max() < 1 << 52:
        width = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    else:
        width = np.array([int(x).bit_length() for x in ids], np.uint8)
    # best[i]: the selector at place i; padded so that a window over the end never fits
    best = np.full(n, ESCAPE, np.uint8)
    most, reach = width.copy(), 1
    for selector in range(15, 0, -1):
        count = int(COUNT[selector])
        if count > n:
            break
        while reach < count:
            step = min(reach, count - reach)
            grown = most[: n - reach - step + 1].copy()
            np.maximum(grown, most[step : step + len(grown)], out=grown)
            most, reach = grown, reach + step
        fits = most <= WIDTH[selector]
        if not fits.any():
            break  # then none of the longer, narrower windows fits either
        best[: len(fits)][fits] = selector
    # the places where a word begins: every sixteenth one is found by walking, those between by following all at once
    after = np.append(np.minimum(np.arange(n) + np.maximum(COUNT, 1)[best], n), n)  # an escape takes one id
    far = after
    for _ in range(4):
        far = far[far]
    heads, i = [], 0
    while i < n:
        heads.append(i)
        i = int(far[i])
    begins = [np.array(heads, np.int64)]
    for _ in range(15):
        begins.append(after[begins[-1]])
    at = np.stack(begins, 1).ravel()
    at = at[at < n]
    selectors = best[at]
    escaped = selectors == ESCAPE
    place = np.arange(len(at)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(at) + int(escaped.sum()), np.uint64)
    words[place[escaped] + 1] = ids[at[escaped]]
    for selector in range(1, 16):
        mine = np.flatnonzero(selectors == selector)
        if not len(mine):
            continue
        word = np.full(len(mine), selector << 60, np.uint64)
        for k in range(int(COUNT[selector])):
            if WIDTH[selector]:
                word |= ids[at[mine] + k] << np.uint64(k * WIDTH[selector])
        words[place[mine]] = word
    return words.astype("<u8").tobytes()


def unpack(words: bytes) -> np.ndarray:
    """The ids of :func:`pack`, selector by selector."""
    words = np.frombuffer(words, "<u8")
    selectors = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    if (selectors == ESCAPE).any():
        i, last = 0, len(words)
        marks = np.flatnonzero(selectors == ESCAPE).tolist()
        for i in marks:  # a raw word may look like an escape; it is none
            if not raw[i] and i + 1 < last:
                raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    counts = COUNT[selectors[heads]].copy()
    counts[selectors[heads] == ESCAPE] = 1
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in range(16):
        mine = np.flatnonzero(selectors[heads] == selector)
        if not len(mine):
            continue
        if selector == ESCAPE:
            out[starts[mine]] = words[heads[mine] + 1]
        elif WIDTH[selector]:
            mask = np.uint64((1 << int(WIDTH[selector])) - 1)
            for k in range(int(COUNT[selector])):
                out[starts[mine] + k] = (words[heads[mine]] >> np.uint64(k * WIDTH[selector])) & mask
    return out


#: how the normaliser and the splitter have to be described in a file for texts to be cut into words here
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class WordTokenizer:
    """Ids of a ``tokenizers`` file, as the library gives them.

    In files with the normaliser and the splitter above, white space always separates words and is dropped, so that a
    text's ids are those of its words. Texts of characters below U+0180 (U+0130 apart) are cut into words here then, and
    the library's model encodes each distinct word once; all other texts, those with added tokens, and all texts of other
    files go through the library as they are.
    """

    _plain = regex.compile(r"[\x00-įı-ſ]*")
    _split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        told = json.loads(self.library.to_str())
        self.by_words = told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == _SPLITTER and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        self._special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = iter(range(0x100, 0x200))
        self._byte = [chr(b) if b in keep else chr(next(other)) for b in range(256)]
        self._parts = WordMemo(self._encode_parts, 110_000_000)
        self._words = WordMemo(self._encode_words, 180_000_000)

    def forget(self) -> None:
        """Drop what was remembered of texts."""
        self._parts.forget()
        self._words.forget()

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, byte = self.library.model.tokenize, self._byte
        ids: list[int] = []
        counts = []
        for part in parts:
            tokens = tokenize(part if part.isascii() and part.isprintable() else "".join([byte[b] for b in part.encode()]))
            ids += [t.id for t in tokens]
            counts.append(len(tokens))
        return np.array(ids, np.uint32), np.array(counts, np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        findall = self._split.findall
        split = [[w] if w.isascii() and w.isalpha() else findall(w) for w in words]
        ids, per_part = self._parts.gather(list(chain.from_iterable(split)))
        ends = np.concatenate([[0], np.cumsum(per_part)])[np.cumsum([0, *map(len, split)])]
        return ids, np.diff(ends)

    def encode_batch(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (with ``end_id`` after each text), and each text's count."""
        odd = {i: self.library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if not self.by_words or not (t.isascii() or self._plain.fullmatch(t)) or any(s in t for s in self._special)}
        # words are cut and told apart by Arrow, so that each one of a batch is looked up once
        split = pc.split_pattern(pa.array([t.lower() for i, t in enumerate(texts) if i not in odd], pa.string()), " ")
        own_counts = iter(pc.list_value_length(split).to_pylist())
        counts = [0 if i in odd else next(own_counts) for i in range(len(texts))]
        words = split.flatten().dictionary_encode()
        ids, per_word = self._words.gather(words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum([0, *counts])]
        out = []
        lengths = np.zeros(len(texts), np.int64)
        tail = [] if end_id is None else [end_id]
        for i in range(len(texts)):
            own = np.array(odd[i], np.uint32) if i in odd else ids[ends[i] : ends[i + 1]]
            out += [own, tail]
            lengths[i] = len(own) + len(tail)
        return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32), lengths


def write_token_files(docs: DataFrame, target: str, tokenizer: str, end_id: int | None = 2, block_ids: int = 65_536, parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write block files in ascending doc_id order below ``target``.

    Null texts are empty; repeated doc_ids stand side by side, by text; a document longer than ``block_ids`` gets a
    block of its own; other columns are ignored; an empty table writes an empty file set. The one shuffle is the range
    partitioning by doc_id.
    """
    bound_batches(docs.sparkSession)
    parts = parts or shuffle_partitions(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, size
            docs_, lens, ids = [x for h in held for x in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            row = pa.RecordBatch.from_pylist([{"part": part, "block": block, "first": first, "doc_ids": docs_, "lengths": lens.tolist(), "n_ids": len(ids), "words": pack(ids)}], BLOCK_ARROW)
            block, first, size = block + 1, first + len(ids), 0
            held.clear()
            return row

        with task_state(("tokenizer", tokenizer), lambda: WordTokenizer(tokenizer), keep=True) as own:
            for batch in batches:
                doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
                for a, b in slices(texts):
                    ids, lens = own.encode_batch(texts[a:b], end_id)
                    ends = np.cumsum(lens)
                    i = 0
                    while i < b - a:
                        begin = int(ends[i] - lens[i])
                        j = max(i + 1, int(np.searchsorted(ends, begin + block_ids - size, "right")))
                        j = min(j, b - a)
                        if size and size + int(ends[j - 1]) - begin > block_ids:
                            yield flush()
                            continue
                        held.append((doc_ids[a + i : a + j], lens[i:j], ids[begin : int(ends[j - 1])]))
                        size += int(ends[j - 1]) - begin
                        i = j
            if held:
                yield flush()

    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.parquet(target)


def read_token_files(spark: SparkSession, source: str) -> DataFrame:
    """The block rows of files of :func:`write_token_files`."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(source)


def decode_token_files(spark: SparkSession, source: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids. An empty file set has no rows; documents of a
    null or empty text have their end id only, and none at all if the files were written without one."""
    return _per_document(spark, source, "ids array<long>", pa.field("ids", pa.list_(pa.int64())), lambda own: own.astype(np.int64).tolist())


def token_digests(spark: SparkSession, source: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 of its ids as little-endian unsigned 32-bit integers."""
    return _per_document(spark, source, "ids_crc32 long", pa.field("ids_crc32", pa.int64()), lambda own: zlib.crc32(own.astype("<u4").tobytes()))


def _per_document(spark: SparkSession, source: str, column: str, field: pa.Field, of) -> DataFrame:
    blocks = read_token_files(spark, source)
    # one row for each file part, whose number is a parameter of the writer
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    arrow = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), field])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["words"])
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array([of(ids[a:b]) for a, b in zip(starts, ends, strict=True)], field.type)], schema=arrow)

    rows = blocks.mapInArrow(decode, f"part int, doc_id long, first long, n_tokens long, {column}")
    return rows.join(before, "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", field.name)


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids in ascending doc_id order, reads the files back and digests them; null texts are empty."""
    import public_tokenizers

    target = scratch(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), target, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, target)
