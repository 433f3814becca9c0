"""Exact byte-level BPE by longest matches and backtracking (no Spark here).

Bytes are mapped to the Latin-1 characters of the same number, so that
pyahocorasick can look for tokens. A text's tokens are found from the left: the
longest token that begins here is taken unless merging would not keep the
border to the token before; then the next shorter one, and where none is left
the last token is taken back. A border's fate depends on the two tokens only
and is memoised, and a position that failed once is never tried again, so the
work is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import ahocorasick
import regex

from .pieces import Memo, safe_pieces


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The piece after all merges of rank under below, lowest rank and leftmost first."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
        if rank >= below:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


class Bpe:
    """A vocabulary of ranks. encode() gives what merging by rank gives.

    Every token must be the merge of two tokens of lower rank, as training makes
    them: only then does a border's fate follow from the two tokens beside it.
    Another vocabulary raises ValueError.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.token: list[bytes] = [b""] * size
        self.halves: list[tuple[int, int]] = [(-1, -1)] * size  # the pair whose merge makes the token
        self.pair: dict[tuple[int, int], int] = {}
        self.find = ahocorasick.Automaton()
        reachable = {}
        for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.token[rank] = piece
            if len(piece) > 1:
                parts = merged(piece, ranks, rank)
                if len(parts) != 2:
                    raise ValueError(f"token {rank} ({piece!r}) isn't the merge of two tokens of lower rank, as training makes them")
                left, right = ranks[parts[0]], ranks[parts[1]]
                self.halves[rank] = (left, right)
                self.pair[left, right] = rank
            reachable[piece] = rank
            self.find.add_word(piece.decode("latin-1"), (rank, len(piece)))
        if reachable:
            self.find.make_automaton()
        self.shorter: list[int] = [-1] * size  # the longest reachable token that begins it
        for piece, rank in reachable.items():
            self.shorter[rank] = next((reachable[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in reachable), -1)
        self._fits: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes keeps the border between them."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Undo merges from the latest to the earliest. The border breaks if at some
        # time the two neighbours there could have merged before what was undone last.
        bound = len(self.token)
        while True:
            if self.pair.get((left, right), bound) < bound:
                return False
            a, b = (self.halves[left][1], self.halves[right][0])
            if a < 0 and b < 0:
                return True
            if b < 0 or (a >= 0 and left > right):
                bound, left = left, a
            else:  # of equal ranks the left one merges first, so the right one is undone first
                bound, right = right + 1, b

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list[int] = [-1] * (n + 1)
        for end, (rank, size) in self.find.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = rank  # ends rise, so the last is the longest
        token, shorter, fits = self.token, self.shorter, self.fits
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, now = 0, longest[0]
        while at < n:
            while now >= 0:
                end = at + len(token[now])
                if open_[end] and (not out or fits(out[-1], now)):
                    out.append(now)
                    at, now = end, longest[end]
                    break
                now = shorter[now]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                open_[at] = 0
                now = out.pop()
                at -= len(token[now])
                now = shorter[now]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class TextEncoder:
    """Whole texts: the pattern's matches, each encoded on its own; a bounded memo keeps pieces seen before."""

    def __init__(self, bpe: Bpe, pattern: str) -> None:
        self.bpe = bpe
        # \s of the pattern means the White_Space property; Python's has four characters more.
        self.matches = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.memo = Memo(self._packed)

    def _packed(self, pieces: list[str]) -> list[bytes]:
        out = []
        for piece in pieces:
            ids = [i for m in self.matches.findall(piece) for i in self.bpe.encode(m.encode("utf-8", "surrogatepass"))]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        lists = [safe_pieces(t) for t in texts]
        known = self.memo.learn(lists)
        return [b"".join(map(known.__getitem__, x)) for x in lists]

    def decode(self, packed: bytes) -> bytes:
        return self.bpe.decode(memoryview(packed).cast("I").tolist())


@lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """Built once for a worker process."""
    return TextEncoder(Bpe(load_ranks(path)), pattern)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
