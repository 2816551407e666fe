"""Byte-level BPE by a lazily determinised finite-state transducer, and a streaming decoder.

The merges say which token sequences are encodings: a sequence is one exactly
if each pair of neighbours is the encoding of its own bytes.  That gives a
non-deterministic transducer over bytes whose states are (last token, place in
the vocabulary's trie).  Subset construction, done only for the bytes actually
met, makes it deterministic.  A reading lives at most as long as the longest
token, which bounds the lookahead.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts

#: Characters with the White_Space property; a fixed value of Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0                　"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _ranges(points: list[int]) -> str:
    """The inside of a character class for sorted code points."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "".join(out)


def splitter(pattern: str):
    """A function from text to the matches of ``pattern``, run by the standard library's engine with property classes spelt out.

    The pattern may use ``\\p{L}``, ``\\p{N}``, ``\\s`` and ``\\S``, inside or outside
    brackets.  Texts without characters beyond the Basic Multilingual Plane go by
    classes without them, which that engine looks up in one table.
    """
    import re

    import regex

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    members = {name: [ord(c) for c in regex.findall(name, every)] for name in ("\\p{L}", "\\p{N}")}
    members["\\s"] = members["\\S"] = [ord(c) for c in WHITE_SPACE]

    def compiled(below: int):
        out, inside, i = [], False, 0
        while i < len(pattern):
            name = next((x for x in members if pattern.startswith(x, i)), None)
            if name is None:
                inside = (inside or pattern[i] == "[") and pattern[i] != "]"
                out.append(pattern[i])
                i += 1
                continue
            chars = _ranges([c for c in members[name] if c < below])
            if inside and name == "\\S":
                raise ValueError("\\S inside brackets is not supported")
            out.append(chars if inside else f"[^{chars}]" if name == "\\S" else f"[{chars}]")
            i += len(name)
        return re.compile("".join(out)).findall

    plain, full = compiled(0x10000), compiled(0x110000)
    return lambda text: (plain if len(text.encode("utf-16-le")) == 2 * len(text) else full)(text)


class MergeTransducer:
    """``encode(piece)``: the BPE tokens of one piece of bytes, in one pass over them.

    A determinised state is the set of live readings (last token, trie node); the
    one output of a move is the token that ends the encoding of the bytes read so
    far, of which there is at most one.  Tokens leave by following these outputs
    back from a byte at which a single reading is alive, or from the end.

    At most ``max_states`` determinised states are kept; beyond that all are
    forgotten and built anew as needed, so memory is bounded and results are not
    touched.
    """

    #: Keys of a state besides bytes: its readings, and the token that the whole piece is.
    READINGS, WHOLE = -1, -2

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000, max_pairs: int = 300_000):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.clear()  # states refer to each other in circles
        self.start = {self.READINGS: ((-1, 0),), self.WHOLE: -1}
        self.states = {self.start[self.READINGS]: self.start}

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """The definition: merge the neighbours of lowest rank until none (of a rank under ``below``) are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte, or if no merges lead to it."""
        if token not in self.halves:
            parts = self.merged(self.bytes_of[token], token)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border between the two tokens.

        The last merges on either side are undone, latest first; a pair across
        the border that would have merged before the one just undone forbids it.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        a, b, below, known = left, right, 1 << 60, True
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < below:
                known = False
                break
            x, y = self._halves(a), self._halves(b)
            # equal ranks: merges run from the left, so the right one is the later
            if x and (not y or a > b):
                below, a = a, x[1]
            elif y:
                below, b = b + (1 if not x or b >= a else 0), y[0]
            else:
                break
        if len(self.pairs) >= self.max_pairs:
            self.pairs.clear()
        self.pairs[key] = known
        return known

    def _step(self, state: dict, b: int) -> tuple[int, dict]:
        alive, candidates, whole = [], [], -1
        children, token_at = self.children, self.token_at
        for last, node in state[self.READINGS]:
            node = children[node].get(b)
            if node is None:
                continue
            token = token_at[node]
            if token >= 0:
                if last < 0:
                    whole = token
                candidates.append((last, token))
            if children[node]:
                alive.append((last, node))
        # exactly one candidate ends the encoding of the bytes so far: the last needs no test
        ends = -1
        for last, token in candidates:
            if token == candidates[-1][1] or last < 0 or self._neighbours(last, token):
                ends = token
                break
        if ends >= 0:
            alive.append((ends, 0))
        key = (*alive, whole)
        nxt = self.states.get(key)
        if nxt is None:
            if len(self.states) >= self.max_states:
                self._forget()
            nxt = self.states[key] = {self.READINGS: tuple(alive), self.WHOLE: whole}
        move = state[b] = (ends, nxt)
        return move

    def encode(self, piece: bytes) -> tuple[int, ...]:
        state, ends, step = self.start, [], self._step
        add = ends.append
        if len(piece) <= 4096:
            for b in piece:
                token, state = state.get(b) or step(state, b)
                add(token)
            # a piece that is itself a token is that token
            return (state[self.WHOLE],) if state[self.WHOLE] >= 0 else tuple(self._back(ends))
        out = []
        for b in piece:
            token, state = state.get(b) or step(state, b)
            ends.append(token)
            if len(ends) >= 4096 and token >= 0 and len(state[self.READINGS]) == 1:
                out.extend(self._back(ends))
                ends = []
        return tuple(out + self._back(ends))

    def _back(self, ends: list[int]) -> list[int]:
        out, at, bytes_of = [], len(ends), self.bytes_of
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= len(bytes_of[token])
        out.reverse()
        return out


class _Pieces(dict):
    """Tokens of pieces met before; long pieces are not kept, and a full table starts anew."""

    def __init__(self, transducer: MergeTransducer, most: int = 200_000):
        super().__init__()
        self.transducer, self.most = transducer, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        tokens = self.transducer.encode(piece.encode())
        if len(piece) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[piece] = tokens
        return tokens


class Tokenizer:
    """Whole texts to token ids."""

    def __init__(self, path: str, pattern: str):
        self.split = splitter(pattern)
        self.transducer = MergeTransducer(read_ranks(path))
        self.pieces = _Pieces(self.transducer)

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))


class Utf8Machine:
    """Incremental UTF-8: feed bytes, get the text of the characters complete so far.

    The state is the number of bytes a character still needs and the bytes held
    back for it.  Only the last three bytes of a chunk can belong to an
    unfinished character, so the machine steps over those alone.
    """

    #: Bytes that follow a lead byte, by its high bits; fixed by the encoding.
    def __init__(self):
        self.held = b""

    @staticmethod
    def _needs(lead: int) -> int:
        return 0 if lead < 0x80 else 1 if lead >> 5 == 0b110 else 2 if lead >> 4 == 0b1110 else 3 if lead >> 3 == 0b11110 else -1

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                if self._needs(lead) >= back:
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(chunks: Iterable[Iterable[int]], vocabulary) -> Iterator[str]:
    """Text of token ids that arrive in chunks; a character may be spread over tokens and chunks."""
    machine = Utf8Machine()
    for ids in chunks:
        text = machine.feed(b"".join(map(vocabulary.__getitem__, ids)))
        if text:
            yield text
    rest = machine.close()
    if rest:
        yield rest


_LOADED: dict[tuple[str, str], Tokenizer] = {}
_VOCABULARIES: dict[str, dict[int, bytes]] = {}


def _vocabulary_of(path: str) -> dict[int, bytes]:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = {rank: token for token, rank in read_ranks(path).items()}
    return _VOCABULARIES[path]


@contextlib.contextmanager
def _without_collector():
    """The caches hold millions of objects and no garbage in circles: the cycle collector only costs time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _tokenizer(path: str, pattern: str) -> Tokenizer:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Tokenizer(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, chunk: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, ids array<int>, *keep) of every whole text; no exchange.

    With ``decoded`` also text, the ids decoded again in chunks by ``decode_stream`` in
    the same pass: one Python worker per task holds the caches instead of two.

    ``path`` is a file that each machine of the cluster has.  Null and empty texts
    have no tokens; bytes that are not UTF-8 are encoded as the replacement character; repeated rows are encoded each; no rows give no rows; columns
    named in ``keep`` pass through unread, others are ignored.
    """
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                with _without_collector():
                    ids = [tokenizer.encode(t) if t else [] for t in texts(part.column(1))]
                columns, names = [part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                if decoded:
                    vocabulary = tokenizer.transducer.bytes_of
                    back = ["".join(decode_stream((x[i : i + chunk] for i in range(0, len(x), chunk)), vocabulary)) for x in ids]
                    columns.append(pa.array(back, pa.string()))
                    names.append("text")
                columns += [part.column(2 + i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns, names + [f"k{i}" for i in range(len(keep))])

    source = bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    out = source.mapInArrow(run, f"doc_id {kinds['doc_id']}, ids array<int>" + ", text string" * decoded + "".join(f", k{i} {kinds[f'k{i}']}" for i in range(len(keep))))
    return out.select("doc_id", "ids", *["text"] * decoded, *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def decode(encoded: DataFrame, path: str, chunk: int = 4096) -> DataFrame:
    """``encoded`` (doc_id, ids, ...) with its text decoded in chunks of ``chunk`` ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for ids in part.column(1):
                    if not ids.is_valid:
                        texts.append(None)
                        continue
                    values = ids.values.to_pylist()
                    texts.append("".join(decode_stream((values[i : i + chunk] for i in range(0, len(values), chunk)), vocabulary)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    source = bounded_batches(encoded).select("doc_id", "ids")
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>, text string")


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def digest_columns() -> list:
    """The digest columns of decoded rows (doc_id, ids, text)."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    ]


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    path, pattern = _vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, path, pattern, decoded=True).select("doc_id", *digest_columns())
