"""Cutting texts where a byte-level BPE cuts them anyway, and remembering what the pieces give."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import islice

# White space as the tokenizers' patterns know it: what Python calls white space, less U+001C to U+001F.
_PIECE = re.compile(r"\s*\S+|\s+")
_PIECE_ODD = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_WORD_ODD = re.compile(r"[\S\x1c-\x1f]+")
_ODD = re.compile(r"[\x1c-\x1f]")
#: Entries of a memo (a worker process keeps one); longer pieces and those that come later are worked out anew.
MEMO, LONGEST = 300_000, 64


def safe_pieces(text: str) -> list[str]:
    """The text cut before every run of white space that follows something else.

    No match of the byte-level pattern goes from another character to white
    space, and none looks past such a place, so the pieces' tokens are the
    text's tokens. Their concatenation is the text.
    """
    return (_PIECE_ODD if _ODD.search(text) else _PIECE).findall(text)


def words(text: str) -> list[str]:
    """The text's parts between white space, for vocabularies that drop white space."""
    return _WORD_ODD.findall(text) if _ODD.search(text) else text.split()


class Memo(dict):
    """What each piece gives; bounded. make takes a list of new pieces and returns what they give."""

    def __init__(self, make: Callable[[list[str]], list], limit: int = MEMO) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def learn(self, lists: Iterable[Iterable[str]]) -> dict:
        """Results for all pieces of the lists: this memo, or a larger one for this call alone where it can't hold them."""
        new = set().union(*lists)
        new.difference_update(self)
        if not new:
            return self
        pieces = list(new)
        made = dict(zip(pieces, self.make(pieces), strict=True))
        room = self.limit - len(self)
        short = made if max(map(len, pieces)) <= LONGEST else {k: v for k, v in made.items() if len(k) <= LONGEST}
        if short is made and len(made) <= room:
            self.update(made)
            return self
        known = dict(self)
        known.update(made)
        if room > 0:
            self.update(islice(short.items(), room))
        return known
