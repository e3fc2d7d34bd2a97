"""Bulk-synchronous best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised in parallel and range-sorted by length: each piece gets its rank among all pieces of its
length (counts per partition and length, prefix sums, no group of rows in one task). Packing then goes in
supersteps. A superstep takes one run, all pieces of one length, longest first, and matches it to the sorted gaps by a
successor sweep: the smallest gap that holds the length comes first. Where several pieces want one gap, rank decides.
Gaps are updated in bulk and the next superstep follows. Pieces of a run are interchangeable, so a superstep moves
counted runs of pieces and gaps instead of single rows; there are at most `limit` lengths, which bounds the
sweep by the sequence length, whatever the corpus. The plan (rank interval -> sequences and offset) goes
back to all executors, which place their pieces by binary search. The result equals sequential best-fit decreasing.

Defined results: a null text is empty and becomes a piece of one token (the separator); very long texts are cut into pieces, whole;
ties: of pieces of one length, that which comes first by partition and row takes the first place; repeated rows and repeated ids are
packed as often as they occur; null ids stay null; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, worker_cache

#: Fixed value: the pattern by which `tokenizers`' byte-level pre-tokenizer splits.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable Latin-1 characters stand for themselves, the others, in order, for the
    characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class FileIds:
    """Ids of whole texts by a `tokenizers` file, little-endian unsigned 32-bit.

    tiktoken's encoder, which is faster, joins any two neighbours whose bytes are a ranked token, the lowest rank first, and takes a
    whole piece that is a token as it is; `tokenizers` joins only listed pairs, in the list's order. Both give the same ids,
    split by the same pattern, if merges' ids ascend and if the listed merges alone build every token from its own bytes (proved()).
    For the first pair that only tiktoken would join, a and b, spans a token t; nothing has crossed t's edges, so what happened
    inside is what the list does to t alone, and the list takes t's last two parts to t. So that pair is listed.
    Files that don't pass, texts that hold an added token, other patterns and other kinds of files go to `tokenizers`."""

    def __init__(self, path: str, pattern: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranked = None
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if pattern == BYTE_LEVEL and model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout"):
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            made = [model["vocab"][a + b] for a, b in merges]
            byte = byte_of_char()
            plain = {t: i for t, i in model["vocab"].items() if t not in self.added}
            if made == sorted(set(made)) and not model.get("byte_fallback") and proved(self.tokenizer, plain, byte):
                ranks = {bytes(byte[c] for c in t): i for t, i in plain.items()}
                self.ranked = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.ranked is None or any(a in text for a in self.added):
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def proved(tokenizer, vocab: dict[str, int], byte: dict[str, int]) -> bool:
    """Whether every byte is a token, and the listed merges make of every token's own bytes that token and nothing else."""
    merges = tokenizer.model
    return all(c in vocab for c in byte) and all(set(t) <= byte.keys() and [x.id for x in merges.tokenize(t)] == [i] for t, i in vocab.items())


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if it fits, else full pieces with the shorter one first."""
    first = n % limit or limit
    return [(0, first)] + [(at, limit) for at in range(first, n, limit)]


def pieces(docs: DataFrame, to_ids: Callable[[], Callable[[str], bytes]], limit: int, separator: int, id_col: str, text_col: str) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and its place: part (partition) and nth (of its length there)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ids_of, part = to_ids(), TaskContext.get().partitionId()
        seen = [0] * (limit + 1)
        end = separator.to_bytes(4, "little")
        names = ["piece", "start", "length", "ids_crc32", "part", "nth"]
        for b in batches:
            at: list[int] = []
            cols: list[list[int]] = [[] for _ in names]
            for i, text in enumerate(b.column(1)):
                ids = ids_of(text.as_py() or "") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, limit)):
                    at.append(i)
                    for col, v in zip(cols, (k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), part, seen[n]), strict=True):
                        col.append(v)
                    seen[n] += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", *names])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit by supersteps over runs. counts: pieces by length. Rows (length, first rank, first sequence, first offset,
    pieces per sequence): ranks from there to the next row's first rank fill sequences one after another."""
    gaps: list[int] = []  # sorted sizes of open gaps
    runs: dict[int, list[tuple[int, int]]] = {}  # by size: runs of sequences (first, count) with that gap
    made, out = 0, []

    def leave(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in runs:
                bisect.insort(gaps, size)
            runs.setdefault(size, []).append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):  # the successor: the smallest gap that holds this length
                size = gaps[at]
                first, n = runs[size].pop()
                if not runs[size]:
                    del runs[size]
                    gaps.pop(at)
                is_new = False
            else:
                size, is_new = limit, True
                first = made
                n = -(-left // (limit // length))
            each = size // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, first, limit - size, each))
                rank, left = rank + full * each, left - full * each
                leave(size - each * length, first, full)
            rest = left if full < n else 0  # too few for one more sequence to get as many
            if rest:
                out.append((length, rank, first + full, limit - size, rest))
                leave(size - rest * length, first + full, 1)
                rank, left = rank + rest, 0
            if is_new:
                made = first + full + bool(rest)
            else:
                leave(size, first + full + bool(rest), n - full - bool(rest))
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    limit: int = 2048,
    separator: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""

    def to_ids():
        return worker_cache(f"ids:{tokenizer_path}", lambda: FileIds(tokenizer_path, pattern)).ids

    return place(materialize(pieces(docs, to_ids, limit, separator, id_col, text_col), "pieces"), limit)


def place(found: DataFrame, limit: int) -> DataFrame:
    """Packs the rows of pieces() (stable: a written table) and returns them with sequence_id and offset."""
    by_part = materialize(found.groupBy("length", "part").agg(F.count("*").alias("n")), "runs")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limit rows
    rows = sorted(plan(counts, limit))
    if not rows:
        return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select(F.col("length").alias("_length"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = found.join(starts, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("nth")).alias("rank")
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(rows, "i8")
        # one sorted key for (length, rank): ranks start anew at each length
        base = np.searchsorted(table[:, 0], np.arange(limit + 2))
        for b in batches:
            length, rank = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            at = np.empty(len(rank), "i8")
            for n in np.unique(length):
                mine = length == n
                lo, hi = base[n], base[n + 1]
                at[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], side="right") - 1
            _, first_rank, first, offset, each = table[at].T
            nth = rank - first_rank
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first + nth // each), pa.array(offset + nth % each * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
