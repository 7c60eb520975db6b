"""Edit-aware token counts.

Each document has a segment tree over runs of pre-tokens, with sums of characters and tokens. An
edit re-encodes only the runs it touches and a little context, then updates the sums on the path to
the root; the rest of the document is never encoded again.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_bytes

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens in a leaf.
LEAF = 32
#: How far beyond its end the pre-token pattern can look (``\\s+(?!\\S)`` gives back one character and
#: reads one more; a contraction reads two characters after an apostrophe).
LOOKAHEAD = 3
MEMO = 300_000
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64()), ("n_edits", pa.int64()),
    ("n_tokens_edited", pa.int64()), ("n_reencoded", pa.int64()),
])

#: The edits of the production query: what a release of the corpus replaces.
REDACTIONS = regex.compile(
    r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<number>(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z]))"
    r"|(?P<key>(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z]))"
)


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Token counts of pre-tokens, with a memo of two generations."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # the same pattern with white space spelt as the Unicode property in every engine
        spelt = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.pattern = regex.compile(spelt)
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> np.ndarray:
        memo = self.memo
        missing = [p for p in set(pieces) if p not in memo]
        if missing:
            if len(memo) > MEMO:
                self.memo, self.old = {}, memo
                memo = self.memo
                missing = set(pieces)
            old, encode = self.old, self.encoding._encode_single_piece
            for p in missing:
                n = old.get(p)
                memo[p] = len(encode(p)) if n is None else n
        if len(pieces) == 1:
            return np.array([memo[pieces[0]]], np.int64)
        return np.array(itemgetter(*pieces)(memo), np.int64) if pieces else np.zeros(0, np.int64)


class Tree:
    """Sums of characters and tokens over leaves."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        size = 1
        while size < max(len(chars), 1):
            size *= 2
        self.size = size
        self.sums = np.zeros((2 * size, 2), np.int64)
        self.sums[size : size + len(chars), 0] = chars
        self.sums[size : size + len(tokens), 1] = tokens
        k = size
        while k > 1:
            self.sums[k // 2 : k] = self.sums[k : 2 * k : 2] + self.sums[k + 1 : 2 * k : 2]
            k //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf holding a character, and where it begins; the last one for positions at the end."""
        k, before = 1, 0
        pos = min(pos, max(self.chars - 1, 0))
        while k < self.size:
            left = int(self.sums[2 * k, 0])
            if pos - before < left:
                k = 2 * k
            else:
                before += left
                k = 2 * k + 1
        return k - self.size, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.size
        change = np.array([chars, tokens], np.int64) - self.sums[k]
        while k:
            self.sums[k] += change
            k //= 2


class Document:
    """One text with its tree. Leaves are slices of the text as it was read; those that edits have
    changed are kept beside it, so an edit copies its own leaves and nothing else."""

    def __init__(self, text: str, counter: PieceCounter):
        self.counter = counter
        pieces = counter.pattern.findall(text)
        self.n_pieces = len(pieces)
        self.reencoded = 0
        first = np.arange(0, max(len(pieces), 1), LEAF)
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces)) if pieces else np.zeros(1, np.int64)
        tokens = counter.counts(pieces) if pieces else np.zeros(1, np.int64)
        self._lay(text, np.add.reduceat(chars, first), np.add.reduceat(tokens, first))

    def _lay(self, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.source, self.changed, self.leaves = text, {}, len(chars)
        self.starts = np.concatenate(([0], np.cumsum(chars)))
        self.tree = Tree(chars, tokens)

    def _leaf(self, k: int) -> str:
        got = self.changed.get(k)
        return self.source[self.starts[k] : self.starts[k + 1]] if got is None else got

    @property
    def text(self) -> str:
        return "".join(map(self._leaf, range(self.leaves))) if self.changed else self.source

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace text[start:end]. Leaves from the last one that ends LOOKAHEAD before the edit up to
        the first old leaf boundary behind it at which the new pre-tokens break too are encoded again.
        Leaves are read on from the edit, twice as many each time, until that boundary is found."""
        leaf, at = self.tree.leaf_at(max(start - LOOKAHEAD, 0)) if self.tree.chars else (0, 0)
        start, end, more = start - at, end - at, 2
        shift, safe = len(replacement) - (end - start), start + len(replacement)
        old: list[str] = []
        ends: list[int] = []
        while True:
            while leaf + len(old) < self.leaves and (more or ends[-1] < end):
                more -= bool(ends and ends[-1] >= end)
                old.append(self._leaf(leaf + len(old)))
                ends.append((ends[-1] if ends else 0) + len(old[-1]))
            whole = leaf + len(old) == self.leaves
            joined = "".join(old)
            pieces, last = self._resync(joined[:start] + replacement + joined[end:], ends, end, safe, shift, whole)
            if last is not None:
                break
            more = len(old)
        self.reencoded += len(pieces)
        self._put(leaf, last + 1, pieces)

    def _resync(self, text: str, ends: list[int], end: int, safe: int, shift: int, whole: bool) -> tuple[list[str], int | None]:
        """Pre-tokens up to the first old boundary that is a new one too, and the number of the leaf that
        ends there; no number if the leaves read so far do not tell."""
        pieces, stop = [], bisect_left(ends, end)
        for m in self.counter.pattern.finditer(text):
            q = m.end()
            if not whole and q + LOOKAHEAD > len(text):
                return pieces, None
            pieces.append(m.group())
            if q >= safe:
                while stop < len(ends) and ends[stop] < q - shift:
                    stop += 1
                if stop < len(ends) and ends[stop] == q - shift:
                    return pieces, stop
        return pieces, len(ends) - 1 if whole else None

    def _put(self, leaf: int, n: int, pieces: list[str]) -> None:
        """The pre-tokens in place of n leaves: full leaves first, empty ones behind; new leaves if they overflow."""
        per = max(LEAF, -(-len(pieces) // n))
        split = per > 8 * LEAF
        per = LEAF if split else per
        first = np.arange(0, len(pieces), per)
        texts = ["".join(pieces[a : a + per]) for a in first.tolist()]
        chars = np.array([len(t) for t in texts], np.int64)
        tokens = np.add.reduceat(self.counter.counts(pieces), first) if pieces else np.zeros(0, np.int64)
        if split:
            own = self.tree.sums[self.tree.size : self.tree.size + self.leaves]
            around = lambda column, new: np.concatenate([own[:leaf, column], new, own[leaf + n :, column]])
            whole = "".join([*map(self._leaf, range(leaf)), *texts, *map(self._leaf, range(leaf + n, self.leaves))])
            self._lay(whole, around(0, chars), around(1, tokens))
            return
        for k in range(n):
            self.changed[leaf + k] = texts[k] if k < len(texts) else ""
            self.tree.put(leaf + k, *((int(chars[k]), int(tokens[k])) if k < len(texts) else (0, 0)))


def redactions(text: str) -> list[tuple[int, int, str]]:
    if "@" not in text and not any(c in text for c in "0123456789"):
        return []
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in REDACTIONS.finditer(text)]


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = PieceCounter(path)
    for batch in sliced(batches, "text"):
        rows = []
        for raw in batch.column("text").to_pylist():
            text = raw.decode("utf-8", "replace")
            doc = Document(text, counter)
            n = doc.tree.tokens
            edits = redactions(text)
            for start, end, new in reversed(edits):
                doc.edit(start, end, new)
            rows.append((n, doc.n_pieces, len(edits), doc.tree.tokens, doc.reencoded))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=SCHEMA)


def op1(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token counts of every document before and after the redaction edits.

    Null and empty texts count 0; repeated rows give repeated rows; a null doc_id stays null. ``n_reencoded`` is the number of
    pre-tokens that the edits made the operator encode again.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(
        partial(_count, path=path or ranks_path()),
        "doc_id long, n_tokens long, n_pretokens long, n_edits long, n_tokens_edited long, n_reencoded long",
    )
