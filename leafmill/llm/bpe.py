"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A token sequence is the BPE encoding of its bytes exactly if every neighbouring pair of tokens is the encoding of
its own bytes. That makes the encoder a nondeterministic transducer: a thread is (last token, bytes of the token in
progress), and it may close a token whenever the pair rule allows. After each byte exactly one thread has just
closed a token. Determinised on demand, a state is the set of live threads with the tokens they don't share yet;
a token goes out as soon as all live threads agree on it, at most one token's length later (bounded lookahead).

What a worker remembers is bounded: states (also within one piece), pieces of at most LONGEST characters, pairs of tokens. A long
text is worked through some matches at a time, and a long piece byte by byte.

Defined results: null and empty texts encode to no tokens (decoding to no bytes); very long texts and pieces are encoded whole;
repeated rows each get a row; an empty table gives an empty table; further columns of the input are ignored. A vocabulary with tokens that their own
merges don't build is encoded by its merges, where the tiktoken library would take such a token for a whole piece; the given file has none.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from array import array

from pyspark.sql import DataFrame

from .common import LONGEST, worker_cache

#: White space as the Unicode property has it (Python's own \s has four control characters more).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The properties that ascii_splitter() spells out.
LETTER, DIGIT = "\\p{L}", "\\p{N}"
#: Bounds of what a worker remembers: states, pieces, pairs of tokens.
MAX_STATES, MAX_PIECES, MAX_PAIRS = 300_000, 500_000, 400_000
#: Matches of a text that are worked on at once.
MATCHES = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its id in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def splitter(pattern: str):
    """The pattern compiled, with white space as Unicode defines it."""
    import regex

    return regex.compile(spaced(pattern, _SPACE))


def spaced(pattern: str, space: str) -> str:
    return pattern.replace("[^\\s", f"[^{space}").replace("\\S", f"[^{space}]").replace("\\s", f"[{space}]")


def ascii_splitter(pattern: str):
    """The same matches in texts of ASCII characters alone, where letters and digits are plain ranges that the standard
    library's machine takes in a third of the time. A pattern with other properties or syntax gets splitter()."""
    plain = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(LETTER, "A-Za-z").replace(DIGIT, "0-9"), spaced(pattern, "\\t-\\r "))
    plain = plain.replace(LETTER, "[A-Za-z]").replace(DIGIT, "[0-9]")
    try:
        if "\\p" not in plain and "\\P" not in plain:
            return re.compile(plain)
    except re.error:
        pass
    return splitter(pattern)


def merge(ranks: dict[bytes, int], piece: bytes, stop: int = 1) -> list[int]:
    """Encoding by repeated merges of the lowest-ranked neighbours, down to stop parts; splits tokens into halves and is the tests' yardstick."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Remembered(dict):
    """A bounded memory of two generations: a full one becomes the older, and what is met again moves to the younger."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most // 2, {}

    def recall(self, key):
        """The value of a key that isn't in the younger generation, or None."""
        value = self.older.get(key)
        if value is not None:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class Transducer:
    """Encodes pieces of bytes; states and transitions are made when first needed and dropped when too many.

    Tokens lie in a trie, whose nodes are numbered; `child` leads from (node, byte) to a node, `token_at` has a node's token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {v: k for k, v in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.child.get(key) or self.child.setdefault(key, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, int], list[tuple[bytes, int, int]]] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.start = self.state(((-1, 0, ()),))

    def state(self, threads: tuple) -> dict:
        """The row of a state: byte -> (row, tokens out); under -1 the tokens that end the piece here. The last thread
        is the one that has just closed a token."""
        row = self.states.get(threads)
        if row is None:
            row = self.states[threads] = {-1: threads[-1][2], -2: threads}
        return row

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = left < 0 or not self.crosses(left, right)
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if token not in self.split:
            parts = merge(self.ranks, self.tokens[token], stop=2)
            self.split[token] = tuple(parts) if len(parts) == 2 else None
        return self.split[token]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The token's parts at its left (0) or right (1) edge, each with its rank and the rank that consumes it."""
        key = (token, side)
        if key not in self.edges:
            out, over = [], 1 << 60
            at: int | None = token
            while at is not None:
                out.append((self.tokens[at], -1 if len(self.tokens[at]) == 1 else at, over))
                over, at = at, (self.halves(at) or (None, None))[side]
            self.edges[key] = out
        return self.edges[key]

    def crosses(self, left: int, right: int) -> bool:
        """Whether some merge would join the right edge of one token to the left edge of the next before both are whole.

        Parts a and b meet while neither is consumed; their joint token wins if it ranks before what consumes b, and
        strictly before what consumes a (of equal ranks the leftmost merge goes first, and a's lies to the left)."""
        get = self.ranks.get
        for a, made_a, over_a in self.edge(left, 1):
            for b, made_b, over_b in self.edge(right, 0):
                if made_a < over_b and made_b < over_a:
                    rank = get(a + b)
                    if rank is not None and rank < over_a and rank <= over_b:
                        return True
        return False

    def step(self, row: dict, byte: int) -> tuple[dict, tuple]:
        threads, closed = [], None
        child, token_at = self.child, self.token_at
        for last, node, pending in row[-2]:
            to = child.get(node << 8 | byte)
            if to is not None:
                threads.append((last, to, pending))
                token = token_at[to]
                if token >= 0 and closed is None and self.fits(last, token):
                    closed = (token, 0, (*pending, token))
        first = threads[0][2] if threads else closed[2]
        threads.append(closed)
        shared = len(first)
        if shared:  # what all live threads agree on goes out
            for _, _, p in threads:
                if p[:shared] != first[:shared]:
                    shared = next(k for k in range(shared) if k >= len(p) or p[k] != first[k])
                    if not shared:
                        break
        if shared:
            threads = [(last, node, p[shared:]) for last, node, p in threads]
        row[byte] = made = (self.state(tuple(threads)), first[:shared])
        return made

    def encode(self, piece: bytes) -> list[int] | array:
        """The piece's tokens. States are dropped when too many, within a piece too: the machine goes on from the threads it is in."""
        if len(self.states) > MAX_STATES:
            self.reset()
        row, out = self.start, [] if len(piece) < MATCHES else array("I")
        for byte in piece:
            made = row.get(byte)
            if made is None:
                if len(self.states) > MAX_STATES:
                    threads = row[-2]
                    self.reset()
                    row = self.state(threads)
                made = self.step(row, byte)
            row = made[0]
            if made[1]:
                out.extend(made[1])
        out.extend(row[-1])
        return out


class Encoder:
    """Whole texts to ids: the pattern's matches one by one, each by the transducer, finished pieces remembered."""

    def __init__(self, ranks_path: str, pattern: str):
        self.transducer = Transducer(load_ranks(ranks_path))
        self.find, self.find_ascii = splitter(pattern), ascii_splitter(pattern)
        self.known = Remembered(MAX_PIECES)
        self.bytes_of = [self.transducer.tokens.get(i, b"") for i in range(max(self.transducer.tokens) + 1)]

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        find = self.find_ascii if text.isascii() else self.find
        if len(text) <= MATCHES:
            return self.join(find.findall(text))
        matches = (m[0] for m in find.finditer(text))
        return b"".join(iter(lambda: self.join(list(itertools.islice(matches, MATCHES))), b""))

    def join(self, pieces: list[str]) -> bytes:
        """The ids of some matches; no match is empty, so only no matches have none."""
        known = self.known
        known.turn()
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            own = {}  # long pieces are not remembered beyond their text
            for p in pieces:
                if p not in known and p not in own and known.recall(p) is None:
                    ids = self.transducer.encode(p.encode())
                    (known if len(p) <= LONGEST else own)[p] = ids.tobytes() if isinstance(ids, array) else struct.pack(f"<{len(ids)}I", *ids)
            return b"".join([known.get(p) or own[p] for p in pieces])

    def decode(self, ids: bytes, chunk: int = 65536):
        """Complete characters' bytes, chunk by chunk, through the incremental state machine."""
        machine, table = Utf8Machine(), self.bytes_of
        for at in range(0, len(ids), 4 * chunk):
            yield machine.feed(b"".join([table[i] for i in memoryview(ids)[at : at + 4 * chunk].cast("I")]))
        yield machine.end()


class Utf8Machine:
    """Lets through bytes of complete characters and keeps those of an unfinished one (three at most).

    Its state is how many bytes the character in progress still needs. All lead bytes reset it, so only bytes from
    the chunk's last lead byte on can decide the state that the chunk ends in.
    """

    def __init__(self):
        self.kept = b""

    @staticmethod
    def needs(lead: int) -> int:
        return 0 if lead < 0xC0 else 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3

    def feed(self, data: bytes) -> bytes:
        data = self.kept + data
        at = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:
                if self.needs(data[-back]) >= back:
                    at = len(data) - back
                break
            if data[-back] < 0x80:
                break
        self.kept = data[at:]
        return data[:at]

    def end(self) -> bytes:
        out, self.kept = self.kept, b""
        return out


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (binary, little-endian unsigned 32-bit) digest and count, digest of the bytes decoded from the ids."""

    def run(batches):
        import pyarrow as pa

        enc = worker_cache(f"fst:{ranks_path}", lambda: Encoder(ranks_path, pattern))
        for b in batches:
            n, ids_hash, out_hash = [], [], []
            for text in b.column(1):
                ids = enc.encode_bytes(text.as_py() or "")
                out = hashlib.sha256()
                for part in enc.decode(ids):
                    out.update(part)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                out_hash.append(out.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(out_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and token ids (array of int)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = worker_cache(f"fst:{ranks_path}", lambda: Encoder(ranks_path, pattern))
        for b in batches:
            ids = [np.frombuffer(enc.encode_bytes(t.as_py() or ""), "<u4").astype("i4") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Inverse of encode(): id and text; bytes that are not UTF-8 become replacement characters, null ids give null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = worker_cache(f"fst:{ranks_path}", lambda: Encoder(ranks_path, pattern))
        for b in batches:
            texts = [None if x.as_py() is None else b"".join(enc.decode(np.array(x.as_py(), "<u4").tobytes())).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = tokens.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
