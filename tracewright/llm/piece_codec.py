"""Exact encoding and decoding with a SentencePiece BPE model, without the library's merge queue.

A sequence of pieces is what merging yields if and only if its first piece is what merging makes of that piece's own
characters and merging any two adjacent pieces' characters yields those two pieces again. So a word is encoded from left
to right by longest matches (from one Aho-Corasick pass), each tried against the piece before it; on failure the next
shorter prefix piece is tried, then the piece before is taken back. A bit for each position remembers those from which
the rest can't be encoded. No merge ever spans two characters that stand side by side in no piece, so texts are first cut
there; each distinct part is encoded once per worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import WordMemo, bound_batches, slices, task_state, texts_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceCodec:
    """Encoder and decoder of a BPE model file with identity normalisation, dummy prefix and byte fallback.

    Models of another kind are refused with ValueError. A text's ids equal the library's ``encode`` with sampling off.
    """

    _runs = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        pieces = model.pieces
        if trainer.model_type != trainer.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not trainer.byte_fallback or {p.type for p in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with identity normalisation, dummy prefix and byte fallback, without user-defined or unused pieces")
        if any(SPACE in p.piece.lstrip(SPACE) for p in pieces if p.type == NORMAL):
            raise ValueError("a piece holds white space after other characters")
        self.bos, self.eos = trainer.bos_id, trainer.eos_id
        self.score = {p.piece: p.score for p in pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self.text = [p.piece for p in pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        # the next shorter piece that a piece starts with; a lone character is always a symbol, in the vocabulary or not
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id or k == 1), None) for p in self.id}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self._fits: dict[tuple[str | None, str], bool] = {}
        self._parts = WordMemo(self._encode_parts)
        self._words = WordMemo(self._encode_words)
        surface = {UNKNOWN: lambda p: trainer.unk_surface.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)]), NORMAL: lambda p: p.replace(SPACE, " ").encode()}
        self.surface = [surface[p.type](p.piece) for p in pieces]
        self.kind = np.array([p.type for p in pieces])

    def forget(self) -> None:
        """Drop what was remembered of texts."""
        self._fits.clear()
        self._parts.forget()
        self._words.forget()

    def merged(self, text: str) -> list[str]:
        """What merging makes of ``text``: the best-scored adjacent pair first, the leftmost of equals."""
        symbols = list(text)
        while True:
            best, place = None, -1
            for i in range(len(symbols) - 1):
                score = self.score.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, place = score, i
            if place < 0:
                return symbols
            symbols[place : place + 2] = [symbols[place] + symbols[place + 1]]

    def fits(self, before: str | None, piece: str) -> bool:
        """Whether ``piece`` may follow ``before`` (None: may begin)."""
        key = (before, piece)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 300_000:
                self._fits.clear()
            known = self._fits[key] = self.merged((before or "") + piece) == ([piece] if before is None else [before, piece])
        return known

    def split(self, part: str) -> list[str]:
        """The pieces of a part, by backtracking."""
        n = len(part)
        longest = [1] * n
        for end, length in self.automaton.iter(part):
            longest[end - length + 1] = length  # ends ascend, so the longest comes last
        pieces: list[str] = []
        open_, at = (1 << (n + 1)) - 1, 0
        piece: str | None = part[: longest[0]] if n else None
        while at < n:
            before = pieces[-1] if pieces else None
            while piece is not None:
                end = at + len(piece)
                if open_ >> end & 1 and self.fits(before, piece):
                    break
                piece = self.shorter.get(piece)
            if piece is not None:
                pieces.append(piece)
                at += len(piece)
                piece = part[at : at + longest[at]] if at < n else None
            else:
                open_ &= ~(1 << at)
                piece = pieces.pop()
                at -= len(piece)
        return pieces

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        counts = []
        for part in parts:
            begin = len(ids)
            for piece in self.split(part):
                if (known := self.id.get(piece)) is not None:
                    ids.append(known)
                else:
                    ids += [self.byte_id[b] for b in piece.encode()]
            counts.append(len(ids) - begin)
        return np.array(ids, np.uint32), np.array(counts, np.int64)

    def _cut(self, word: str) -> list[str]:
        word = SPACE + word
        pairs = self.pairs
        cuts = [0, *[i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs], len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = list(map(self._cut, words))
        ids, per_part = self._parts.gather(list(chain.from_iterable(cut)))
        ends = np.concatenate([[0], np.cumsum(per_part)])[np.cumsum([0, *map(len, cut)])]
        return ids, np.diff(ends)

    def encode_batch(self, texts: list[str], bos: bool = True, eos: bool = True) -> list[np.ndarray]:
        words: list[str] = []
        counts = []
        for text in texts:
            if not text:
                own = []
            elif text[0] == " " or "  " in text or SPACE in text:
                own = [run[1:] for run in self._runs.findall(SPACE + text.replace(" ", SPACE))]
            else:
                own = text.split(" ")
            words += own
            counts.append(len(own))
        ids, per_word = self._words.gather(words)
        ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum([0, *counts])]
        head, tail = np.array([self.bos] * bos, np.uint32), np.array([self.eos] * eos, np.uint32)
        return [np.concatenate([head, ids[a:b], tail]) for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids`` as the library's ``decode`` gives it."""
        if (self.kind[ids[1:-1]] == CONTROL).any():
            return self._decode_runs(ids)  # they end a run of byte pieces
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        shown = ids[self.kind[ids] != CONTROL][:1]
        if len(shown) and self.text[int(shown[0])].startswith(SPACE):
            data = data[1:]  # the dummy prefix
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)

    def _decode_runs(self, ids: np.ndarray) -> str:
        """With runs of byte pieces that are no UTF-8: U+FFFD for each byte that begins no character."""
        out: list[str] = []
        first, run = True, bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + k]).decode())
                        i += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for i in ids.tolist():
            if self.kind[i] == BYTE:
                run += self.surface[i]
                first = False
                continue
            flush()
            text = self.surface[i].decode()
            if self.kind[i] != CONTROL:
                out.append(text[1:] if first and self.text[i].startswith(SPACE) else text)
                first = False
        flush()
        return "".join(out)


def encode_documents(docs: DataFrame, model: str, digests: bool = False) -> DataFrame:
    """Encode and decode the whole text of each row of ``docs`` (doc_id, text).

    Returns doc_id, n_tokens and, with ``digests``, ids_sha256 and decoded_sha256, else ids and decoded. Null texts are
    empty (begin and end id only); rows stay as many as they are, also repeated ones; other columns are ignored. Rows are
    mapped where they lie: no shuffle.
    """
    bound_batches(docs.sparkSession)
    fields = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *fields])
    ddl = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_state(("codec", model), lambda: PieceCodec(model)) as own:
            for batch in batches:
                texts = texts_of(batch)
                for a, b in slices(texts):
                    ids = own.encode_batch(texts[a:b])
                    decoded = map(own.decode, ids)
                    if digests:
                        more = [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
                    else:
                        more = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(list(decoded), pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), *more], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(encode, ddl)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all documents' ids and of what they decode to; null texts are empty and have begin and end id only."""
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
