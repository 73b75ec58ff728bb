"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

Encoding a piece of text walks from left to right with the longest vocabulary token at each position (from one
Aho-Corasick pass). A token may follow another only if the merges would not have joined
or cut the two differently; that is answered by a pair-compatibility table, filled on demand from the split of
each token into the two it was merged from. If no token fits, the walk steps back; a bit for each position
keeps it from trying one twice, so the work is linear in the text. The result is that of applying the merges in
order of rank.

Decoding concatenates slices of one blob of all tokens' bytes: an offset table gives each id's start and length, and
a whole Arrow batch is gathered at once.

Defined results: a null text has null ids, no tokens, a null digest and a null round_trip. An empty text has no tokens. Texts of any length are encoded whole,
piece by piece. Rows are independent, so repeated rows give repeated results and an empty table none. ``encode_table``
reads doc_id and text only; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from auditloom.llm.common import frugal

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pieces that merges don't cross, with \s as Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces whose ids a task remembers before it starts anew; this bounds memory only.
CACHE = 150_000
_GATHER = 1 << 16
_LET, _NUM, _WS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: The same for texts without characters above U+00FF, for the faster module.
_NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LET}]+| ?[{_NUM}]+| ?[^{_WS}{_LET}{_NUM}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_WIDE = regex.compile(PATTERN)
_ABOVE = re.compile("[^\x00-\xff]")


def pieces(text: str) -> list[str]:
    return (_WIDE if _ABOVE.search(text) else _NARROW).findall(text)


def load_ranks(path: str = VOCAB) -> list[bytes]:
    """Token bytes by id; ids are ranks of merges, the single bytes first."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


class Encoder:
    """The tables of a vocabulary: next shorter prefix, split, merged pairs, compatibility, and the automaton."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = [t.decode("latin-1") for t in tokens]
        self.size = [len(t) for t in tokens]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.shorter = [next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t in self.tokens]
        self.merged: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.fits: dict[int, bool] = {}
        for i, t in enumerate(self.tokens):
            a = self.shorter[i]
            while a >= 0:
                b = self.ids.get(t[self.size[a] :], -1)
                if a < i and 0 <= b < i and self._compatible(a, b):
                    self.merged[a, b] = i
                    self.left[i], self.right[i] = a, b
                    break
                a = self.shorter[a]
        self.fits = {}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.cache: dict[str, tuple[int, ...]] = _Cache(self)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a then b can stand side by side: undo their last merges, latest first, and look for an earlier merge across the seam."""
        limit = 1 << 60
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                return False
            if a > b:
                limit = a
                a = self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > CACHE:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def piece(self, data: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1 characters that stand for its UTF-8 bytes."""
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        longest = [0] * n
        for end, i in self.automaton.iter(data):  # ends ascend, so the last for a start is the longest
            longest[end - self.size[i] + 1] = i
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + self.size[token]
                if open_at[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return tuple(out)
                token = longest[at]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= self.size[token]
                # the position is closed now, so the same token is passed over for a shorter one

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, pieces(text))))


class _Cache(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        ids = self[piece] = self.encoder.piece(piece.encode("utf-8").decode("latin-1"))
        return ids


class Decoder:
    """Starts and lengths of the tokens in one blob."""

    def __init__(self, tokens: list[bytes]):
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])

    def gather(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids, block by block: places take eight times the room of bytes."""
        if len(ids) > _GATHER:
            return np.concatenate([self.gather(ids[at : at + _GATHER]) for at in range(0, len(ids), _GATHER)])
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.blob[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids) -> bytes:
        return self.gather(np.asarray(ids, np.int64)).tobytes()


_made: dict[str, tuple[Encoder, Decoder]] = {}


def coder(path: str = VOCAB) -> tuple[Encoder, Decoder]:
    """The tables of a vocabulary file, once in a process."""
    if path not in _made:
        tokens = load_ranks(path)
        _made[path] = Encoder(tokens), Decoder(tokens)
    return _made[path]


def encode_table(docs: DataFrame, path: str = VOCAB) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, token_ids, decoded_md5, round_trip) of each row; the digest is that of the ids decoded again.

    The vocabulary file must be there on every executor; it has a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                flat, sizes = array("i"), []
                for t in texts:
                    before = len(flat)
                    if t:
                        flat.extend(chain.from_iterable(map(enc.cache.__getitem__, pieces(t))))
                    sizes.append(len(flat) - before)
                ids = np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                data = dec.gather(ids)
                cut = np.concatenate([[0], np.cumsum(dec.length[ids])])[ends]
                digests, same, n_bytes = [], [], []
                for k, t in enumerate(texts):
                    if t is None:
                        digests.append(None), same.append(None), n_bytes.append(0)
                        continue
                    back, raw = data[cut[k] : cut[k + 1]].tobytes(), t.encode("utf-8")
                    digests.append(hashlib.md5(back).hexdigest()), same.append(back == raw), n_bytes.append(len(raw))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "token_ids", "decoded_md5", "round_trip"],
                )
        enc.cache.clear()
        enc.fits.clear()

    return docs.selectExpr("try_cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(frugal(run), "doc_id bigint, n_bytes bigint, n_tokens bigint, token_ids array<int>, decoded_md5 string, round_trip boolean")


def decode_table(encoded: DataFrame, path: str = VOCAB) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); null ids give a null text, and bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dec = coder(path)
        for batch in batches:
            texts = [None if ids is None else dec.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(frugal(run), "doc_id bigint, text string")
