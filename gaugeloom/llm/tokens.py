"""Token counts by byte-pair merging with a heap over a linked list.

A piece of text starts as one symbol a byte. The adjacent pair of lowest rank is merged
again and again; its count is the number of bytes less the number of merges. No token
identifiers are made. A heap gives the next pair and links make a merge local, so a piece
of n bytes takes n log n steps even if it has no white space at all.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: How the byte-level tokenizer cuts a text into pieces (fixed values).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves, others follow from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts tokens with the merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str, memo: int = 400_000) -> None:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in doc["model"]["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.letters = byte_letters()
        self.pieces = regex.compile(PIECES)
        special = sorted((t["content"] for t in doc.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo: dict[str, int] = {}
        self.memo_most = memo

    def merge(self, piece: str) -> int:
        letters = self.letters
        sym: list[str | None] = [letters[b] for b in piece.encode("utf-8")]
        n = count = len(sym)
        if n < 2:
            return n
        ranks, heap = self.ranks, []
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        for i in range(n - 1):
            r = ranks.get((sym[i], sym[i + 1]))
            if r is not None:
                heap.append((r, i, sym[i], sym[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = a + b, None
            count -= 1
            k = right[j]
            right[i] = k
            if k < n:
                left[k] = i
                r = ranks.get((sym[i], sym[k]))
                if r is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = left[i]
            if h >= 0:
                r = ranks.get((sym[h], sym[i]))
                if r is not None:
                    heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return count

    def plain(self, text: str) -> int:
        memo, total = self.memo, 0
        for piece in self.pieces.findall(text):
            n = memo.get(piece)
            if n is None:
                n = self.merge(piece)
                if len(piece) < 64:
                    if len(memo) >= self.memo_most:
                        memo.clear()
                    memo[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one token and parts the text."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One a worker process, kept between tasks."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    ``tokenizer``: name of an installed tokenizer file, looked up in each worker, or a
    path. A null text counts as empty: 0 bytes, 0 tokens. Null doc_ids and repeated rows
    pass through; other columns are not read. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        for batch in batches:
            # str.splitlines-free: each text is taken whole, one at a time
            counts = [own.count(t.as_py()) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
