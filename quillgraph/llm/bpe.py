"""BPE encoding and decoding with content-defined chunk reuse.

A document is cut into chunks where a rolling hash of its words says so, so shared passages give
the same chunks in whatever document they stand. Each distinct chunk is encoded once, word by word
through a bounded memo of words; chunk joins are then checked by encoding the words around the join
together, and repaired with ever more context until the result agrees with what stands beside it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import partial
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import sliced, text_bytes

VOCABULARY = "word_bpe_49k.json"
#: Words a chunk has on average, and at most.
CHUNK_WORDS, CHUNK_MAX = 64, 512
#: Entries of the worker's memos of words, pieces of words, chunks and joins.
WORD_MEMO, PIECE_MEMO, CHUNK_MEMO, JOIN_MEMO = 200_000, 200_000, 10_000, 30_000
#: Longer words are encoded but not remembered.
MEMO_BYTES = 64
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


#: Latin letters and digits below U+0180: normal form C leaves them alone, they lower-case one to one
#: (U+0130 does not and is left out), and their classes are the same in every regex engine.
_LATIN = [chr(c) for c in range(0xA1, 0x180) if c != 0x130]
_LETTERS = "a-z" + "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "0-9" + "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
_SIMPLE = re.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u017f]+").fullmatch
#: What the shortcut below knows how to do itself; any other file takes the library's whole path.
_KNOWN = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def _is_known(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [])
    return (
        [n.get("type") for n in norm.get("normalizers", [])] == _KNOWN["normalizer"]
        and [n.get("type") for n in steps] == _KNOWN["pre_tokenizer"]
        and steps[0].get("pattern") == {"Regex": _KNOWN["pattern"]}
        and all(t["content"].startswith("<|") for t in spec["added_tokens"])
    )


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary file lies on this machine; vocabularies are never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ChunkEncoder:
    """Encodes whole texts (UTF-8 bytes) exactly as the tokenizers library does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model if _is_known(path) else None
        self.bytes = _byte_alphabet()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # what the memos held before they last filled up: entries still in use move back
        self.old_words: dict[bytes, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.joins: dict[bytes, bool] = {}
        self.reused = self.repaired = 0

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 2048):
            part = [t.decode("utf-8", "replace") for t in texts[i : i + 2048]]
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _word(self, word: str) -> bytes:
        """Ids of a simple word: its pre-tokens, each merged by the model once."""
        out = []
        for piece in _PIECE.findall(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.old_pieces.get(piece)
                if ids is None:
                    mapped = piece if piece.isascii() else "".join([self.bytes[b] for b in piece.encode()])
                    tokens = self.model.tokenize(mapped)
                    ids = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
                if len(piece) <= MEMO_BYTES:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of the words that the memo lacks; short ones are remembered as well."""
        if len(self.words) > WORD_MEMO:
            self.words, self.old_words = {}, self.words
        if len(self.pieces) > PIECE_MEMO:
            self.pieces, self.old_pieces = {}, self.pieces
        missing = [w for w in words if w not in self.words]
        found, hard, old = {}, [], self.old_words
        for w in missing:
            if w in old:
                found[w] = old[w]
                continue
            text = w.decode("utf-8", "replace")
            if self.model is not None and _SIMPLE(text) and "<|" not in text:
                found[w] = self._word(text)
            else:
                hard.append(w)
        found.update(zip(hard, self._encode(hard), strict=True))
        self.words.update(x for x in found.items() if len(x[0]) <= MEMO_BYTES)
        return {w: ids for w, ids in found.items() if len(w) > MEMO_BYTES}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        buf, begins = K.join(texts)
        starts, ends = K.spans(buf)
        if not len(starts):
            return [b""] * len(texts)
        doc = K.doc_of(starts, begins)
        roll = K.ngrams(K.word_hashes(buf, starts, ends), 2)
        cut = np.zeros(len(starts), bool)
        cut[2:] = roll[:-1] % K.U(CHUNK_WORDS) == 0
        cut[np.flatnonzero(np.diff(doc)) + 1] = True
        cut[0] = True
        first = np.flatnonzero(cut)
        # chunks longer than CHUNK_MAX are cut again, counted from their own start
        sizes = np.diff(np.append(first, len(starts)))
        extra = [np.arange(f + CHUNK_MAX, f + n, CHUNK_MAX) for f, n in zip(first[sizes > CHUNK_MAX], sizes[sizes > CHUNK_MAX], strict=True)]
        first = np.sort(np.concatenate([first, *extra]))
        last = np.append(first[1:], len(starts)) - 1
        raw = buf.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)]
        if len(self.chunks) > CHUNK_MEMO:
            self.chunks.clear()
        new = {k: k.split() for k in dict.fromkeys(keys) if k not in self.chunks}
        self.reused += len(keys) - len(new)
        long = self._learn({w for ws in new.values() for w in ws})
        get = self.words.__getitem__ if not long else (lambda w: long[w] if w in long else self.words[w])
        fresh = {k: b"".join(map(get, ws)) for k, ws in new.items()}
        self.chunks.update(x for x in fresh.items() if len(x[0]) < 1 << 14)
        owner = doc[first]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        bad = self._check_joins(keys, owner)
        out = []
        for d in range(len(texts)):
            a, b = int(bounds[d]), int(bounds[d + 1])
            if any(i in bad for i in range(a + 1, b)) if bad else False:
                out.append(self._repair(keys[a:b]))
            else:
                out.append(b"".join([self.chunks[k] if k in self.chunks else fresh[k] for k in keys[a:b]]))
        return out

    def _check_joins(self, keys: list[bytes], owner: np.ndarray) -> set[int]:
        """Joins (by the index of the right chunk) where one encoding of both sides differs from two."""
        if len(self.joins) > JOIN_MEMO:
            self.joins.clear()
        inner = np.flatnonzero(np.diff(owner) == 0) + 1
        around = {}
        for i in inner.tolist():
            left, right = keys[i - 1].rsplit(None, 1)[-1], keys[i].split(None, 1)[0]
            around[i] = left, right
        ask = {}
        for left, right in around.values():
            both = left + b" " + right
            if both not in self.joins and both not in ask:
                ask[both] = left, right
        if ask:
            parts = {w for pair in ask.values() for w in pair}
            long = self._learn(parts)
            word = lambda w: long[w] if w in long else self.words[w]
            for (both, (left, right)), ids in zip(ask.items(), self._encode(list(ask)), strict=True):
                self.joins[both] = ids == word(left) + word(right)
        return {i for i, (left, right) in around.items() if not self.joins[left + b" " + right]}

    def _repair(self, chunks: list[bytes]) -> bytes:
        """Join chunks whose seams do not agree: the text around a seam is encoded again with twice
        the context, until the ids at both rims are those of the chunks, at the latest with all of it."""
        done, ids = chunks[0], self._encode([chunks[0]])[0]
        for nxt in chunks[1:]:
            right = self._encode([nxt])[0]
            lw, rw, n = done.split(), nxt.split(), 2
            while True:
                l_ctx, r_ctx = b" ".join(lw[-n:]), b" ".join(rw[:n])
                joint, l_ids, r_ids = self._encode([l_ctx + b" " + r_ctx, l_ctx, r_ctx])
                whole = n >= len(lw) and n >= len(rw)
                rim = len(joint) >= 8 and joint[:4] == l_ids[:4] and joint[-4:] == r_ids[-4:]
                if (rim and ids.endswith(l_ids) and right.startswith(r_ids)) or whole:
                    break
                n *= 2
            ids = ids[: len(ids) - len(l_ids)] + joint + right[len(r_ids) :]
            done += b" " + nxt
            self.repaired += 1
        return ids


class Decoder:
    """Decodes ids as ``Tokenizer.decode(ids, skip_special_tokens=False)`` does."""

    def __init__(self, encoder: ChunkEncoder):
        self.tok = encoder.tok
        plain = self.tok.decoder is None
        n = self.tok.get_vocab_size()
        # without a decoder the library joins the token strings by single spaces
        self.table = np.array([(self.tok.id_to_token(i) or "").encode() for i in range(n)], object) if plain else None

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        if self.table is None:
            return self.tok.decode(numbers.tolist(), skip_special_tokens=False).encode()
        return b" ".join(self.table[numbers].tolist())


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = ChunkEncoder(path)
    decoder = Decoder(encoder)
    for batch in sliced(batches, "text"):
        ids = encoder.encode(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(decoder.decode(i)).hexdigest() for i in ids], pa.string()),
            ],
            schema=SCHEMA,
        )


def _full(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = ChunkEncoder(path)
    decoder = Decoder(encoder)
    for batch in sliced(batches, "text"):
        ids = encoder.encode(batch.column("text").to_pylist())
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        offsets = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.array([decoder.decode(i).decode() for i in ids], pa.string()),
            ],
            names=["doc_id", "ids", "decoded"],
        )


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of every document; a null text counts as empty
    and gives no ids. Repeated rows give repeated rows. Whole texts of any length."""
    return _input(docs).mapInArrow(partial(_full, path=path or vocabulary_path()), "doc_id long, ids array<int>, decoded string")


def op10(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digest of :func:`encode`: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _input(docs).mapInArrow(
        partial(_digest, path=path or vocabulary_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
