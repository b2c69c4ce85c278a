"""Byte-level BPE by the ``tokenizers`` library, with a cache of pre-token pieces.

The pattern cuts a text into pieces that are encoded each by itself, so the
ids of a text are those of its pieces in order. Prose repeats its pieces: a
worker keeps the ids of the pieces that it has met, encodes those that it
hasn't in one batch with the library, and starts afresh when the cache is full.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os

import numpy as np
import regex

#: Pieces kept by a worker before it starts afresh; about 250 bytes each.
CACHE_PIECES = 300_000


def byte_alphabet() -> dict[int, str]:
    """The byte-to-character table of byte-level BPE: printable bytes stand for themselves, the others for U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token, in the order of ranks: what merging by lower ranks alone leaves of its bytes."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


@functools.lru_cache(4)
def tokenizer_json(path: str) -> str:
    """A ``tokenizers`` definition from a rank file, without special tokens and without a pattern of its own."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_alphabet()
    mapped = {b: "".join(table[x] for x in b) for b in ranks}
    model = models.BPE(vocab={mapped[b]: r for b, r in ranks.items()}, merges=[(mapped[a], mapped[b]) for a, b in merges_of(ranks)])
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made.to_str()


class PieceEncoder:
    """Ids of whole texts by a ``tokenizers`` definition that encodes one piece at a time."""

    def __init__(self, definition: str, pattern: str, max_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pieces = regex.compile(pattern).findall
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}
        back = {c: b for b, c in byte_alphabet().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        self.token_len = np.array([len(x) for x in self.token_bytes], dtype=np.int64)
        self.token_text = [str(i) for i in range(len(self.token_bytes))]

    def learn(self, cut: list[list[str]]) -> None:
        new = list({p for pieces in cut for p in pieces if p not in self.known})
        if len(self.known) + len(new) > self.max_pieces:
            self.known.clear()
            new = list({p for pieces in cut for p in pieces})
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for piece, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[piece] = np.array(e.ids, dtype=np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.pieces(t) for t in texts]
        self.learn(cut)
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, pieces)), dtype=np.int32) for pieces in cut]

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.encode(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens by the reversed byte table; characters split between tokens come together again."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """Start and end of each token in characters, and how many token boundaries lie inside a character.

        A token that begins or ends inside a character covers that whole character.
        """
        ends = np.cumsum(self.token_len[ids])
        starts = ends - self.token_len[ids]
        first = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
        at = np.concatenate([np.cumsum(first) - 1, [int(first.sum())]])
        inside = np.concatenate([~first, [False]])
        return at[starts], np.where(inside[ends], at[ends] + 1, at[ends]), int(inside[ends].sum())

    def ids_text(self, ids: np.ndarray) -> str:
        return " ".join(map(self.token_text.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def encoder(definition: str, pattern: str) -> PieceEncoder:
    """One encoder and cache per worker and definition."""
    return PieceEncoder(definition, pattern)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
