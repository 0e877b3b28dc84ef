"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary's byte strings finds, for every place of a piece of text, the longest token
that begins there. Left to right, the encoder takes the longest token, then shorter prefixes of it, that is compatible with
the token before it; where none is, it goes back one token. Two tokens are compatible if merging their joined bytes by rank
gives just these two: this is read off the tokens' last merges (their split table) without encoding again. A bit per place
marks places that were given up, so each is tried once and the whole is linear in the piece's length.
Pieces (the vocabulary's own pre-tokens) repeat; a table of two generations of bounded size keeps the ids of those seen.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import spans, text_buffer, tidy

#: Fixed value: the pre-token pattern of the vocabulary, with white space as Unicode's White_Space property.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Entries of each of the two generations of the table of pieces seen, the letters of a piece that it keeps, and bytes of ids that bound nothing.
GENERATION, CACHED_LETTERS, ANY_ROOM = 80_000, 48, 1 << 62
PAIRS = 1 << 17
#: Pieces of a text that are looked up at a time, and bytes of texts in one batch of results.
PIECES_AT_A_TIME, BATCH_BYTES = 1 << 16, 1 << 20


class Seen(dict):
    """Ids of pieces by piece, made when first asked for. Two generations of bounded size: a full one becomes the old one.

    A generation is full at so many entries, or at so many bytes of ids (room) where these are many.
    """

    def __init__(self, make: Callable[[str], bytes], generation: int = GENERATION, room: int = ANY_ROOM):
        super().__init__()
        self.make, self.generation, self.room, self.size = make, generation, room, 0
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= CACHED_LETTERS:
            self.size += len(found)
            if len(self) >= self.generation or self.size > self.room:
                self.old = dict(self)
                self.clear()
                self.size = len(found)
            self[piece] = found
        return found


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: printable Latin-1 bytes are themselves, others follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Exact merges of one byte-level vocabulary file."""

    def __init__(self, path: str, generation: int = GENERATION, room: int = ANY_ROOM):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in model["vocab"].items() if s not in self.special}
        self.ids = {b: i for i, b in self.tokens.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        #: The two tokens that a token's last merge joins; itself twice for a single byte.
        self.split: dict[int, tuple[int, int]] = {i: (i, i) for i in self.tokens}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y = self.ids[bytes(letters[c] for c in a)], self.ids[bytes(letters[c] for c in b)]
            z = self.ids[self.tokens[x] + self.tokens[y]]
            self.rank.setdefault((x, y), (n, z))
            if self.split[z] == (z, z):
                self.split[z] = (x, y)
        self.made = {z: n for (n, z) in sorted(self.rank.values(), reverse=True)}
        self.machine = ahocorasick.Automaton()
        for i, b in self.tokens.items():
            self.machine.add_word(b.decode("latin-1"), (i, len(b)))
        self.machine.make_automaton()
        #: The longest proper prefix of a token that is a token too; -1 if none.
        self.shorter = {i: next((self.ids[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ids), -1) for i, b in self.tokens.items()}
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        n = max([*self.tokens, *self.special.values()]) + 1
        blob = [self.tokens.get(i, b"") for i in range(n)]
        for s, i in self.special.items():
            blob[i] = s.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in blob])])
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.length = [len(b) for b in blob]
        #: Pairs of tokens (a << 32 | b) and whether they are compatible; begun anew beyond PAIRS.
        self.pairs: dict[int, bool] = {}
        #: For each token, whether merging its own bytes gives it: 0 not asked yet, 1 no, 2 yes.
        self.own = bytearray(n)
        self.seen = Seen(lambda p: struct.pack(f"<{len(ids := self.piece(p.encode()))}I", *ids), generation, room)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank stops at (a, b).

        It does unless some merge across the border comes before the merges that build a's or b's part of it.
        Going down the split tables, always on the side merged later, looks at each such pair once.
        """
        rank, split, made = self.rank, self.split, self.made
        limit = 1 << 60
        while True:
            got = rank.get((a, b))
            if got is not None and got[0] < limit:
                return False
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # undo the later of the two merges; at equal ranks the left one was made first
            if ra > rb:
                limit, a = ra, split[a][1]
                # the right part of a existed before rank ra, and b by then too
            else:
                limit, b = rb + 1 if rb > ra else rb, split[b][0]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ids.get(data)
        if whole is not None and self._whole(whole):
            return [whole]
        n, length, shorter, pairs = len(data), self.length, self.shorter, self.pairs
        longest = [-1] * n
        # matches come in the order of their ends, so the last one that begins at a place is the longest
        for end, (i, size) in self.machine.iter(data.decode("latin-1")):
            longest[end - size + 1] = i
        out: list[int] = []
        open_, pos, nxt = bytearray(b"\1") * (n + 1), 0, longest[0] if data else -1
        while pos < n:
            token, last = nxt, out[-1] if out else -1
            while token >= 0:
                end = pos + length[token]
                if open_[end]:
                    if last < 0:
                        ok = self._whole(token)
                    else:
                        ok = pairs.get(last << 32 | token)
                        if ok is None:
                            if len(pairs) >= PAIRS:
                                pairs.clear()
                            ok = pairs[last << 32 | token] = self._compatible(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                nxt = longest[pos] if pos < n else -1
                continue
            # nothing fits here after the tokens so far: give the place up, and shorten the token before it
            nxt = -1
            while nxt < 0:
                open_[pos] = 0
                if not out:
                    raise ValueError("no tokens cover the piece")
                nxt = out.pop()
                pos -= length[nxt]
                nxt = shorter[nxt]
        return out

    def _whole(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        if not self.own[token]:
            x, y = self.split[token]
            self.own[token] = 1 + (x == y == token or (self._whole(x) and self._whole(y) and self._compatible_below(x, y)))
        return self.own[token] == 2

    def _compatible_below(self, a: int, b: int) -> bool:
        """Whether a and b stand side by side until their own merge joins them."""
        got = self.rank.pop((a, b))
        try:
            return self._compatible(a, b)
        finally:
            self.rank[(a, b)] = got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, out = self.seen.__getitem__, []
        for part, special in self._parts(text):
            if len(part) <= PIECES_AT_A_TIME:
                out += map(get, self.pieces.findall(part))
            else:
                pieces = (m[0] for m in self.pieces.finditer(part))
                while some := list(itertools.islice(pieces, PIECES_AT_A_TIME)):
                    out.append(b"".join(map(get, some)))
            if special is not None:
                out.append(np.array([special], "<u4").tobytes())
        return b"".join(out)

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        if self.cut is not None:
            for m in self.cut.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], None

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered by the offset table; ids outside the vocabulary give none."""
        ids = ids[ids < len(self.offsets) - 1].astype(np.int64)
        begin = self.offsets[ids]
        length = self.offsets[ids + 1] - begin
        end = np.cumsum(length)
        if not len(ids):
            return b""
        return self.blob[np.arange(end[-1]) + np.repeat(begin - (end - length), length)].tobytes()


@functools.lru_cache(4)
def encoder(path: str, generation: int = GENERATION, room: int = ANY_ROOM) -> Encoder:
    """One encoder for each worker process, file and size of its table of pieces."""
    return Encoder(path, generation, room)


def bpe_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text (null: empty); one row per input row.

    A row whose text is empty has no tokens and the digest of nothing. Repeated rows give repeated results; a null id stays
    null; other columns are ignored, whatever their names; an empty table gives an empty one.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, sha = encoder(vocabulary), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = e.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(e.decode(np.frombuffer(ids, "<u4")).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_columns(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """docs with token_ids (array<int>), n_tokens and decoded (the text that the ids give back) added.

    Columns of these names that docs has already are replaced.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            # results come out in batches of bounded bytes; a longer text stands alone
            _, bytes_to = text_buffer(whole.column(at))
            for first, last in spans(bytes_to, BATCH_BYTES):
                batch = whole.slice(first, last - first)
                ids = [np.frombuffer(e.encode(t.as_py() or ""), "<u4") for t in batch.column(at)]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32))
                decoded = pa.array([e.decode(i).decode("utf-8", "replace") for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat), pa.array(np.diff(offsets).astype(np.int64)), decoded], names=[*batch.schema.names, "token_ids", "n_tokens", "decoded"])

    docs = docs.drop("token_ids", "n_tokens", "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, token_ids array<int>, n_tokens long, decoded string")
