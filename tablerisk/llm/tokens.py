"""Token ids of the pieces of texts, from a public tokenizer.

Both supported kinds cut a text into pieces before they merge: at a single space between two
characters that are not white space a new piece always begins. So a text is split there, pieces
are looked up (``pieces.py``), and only pieces not met before go through the tokenizer, many to a call. One also
begins at a full stop, comma or other of ``SIGNS`` after a letter or digit, so signs that end a piece are tokenized
apart from it: a word occurs with many of them. A text with a run of white space, or with any white space but space
and line feed, goes through the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

TOGETHER = 200
#: Kinds of pieces, in the order in which ``PieceTokenizer.pieces`` gives them.
PLAIN, LINE, EMPTY, UNSAFE = 1, 2, 3, 4
#: Signs before which both kinds begin a new word when they follow a letter or digit. An apostrophe is none: "don't".
SIGNS = ".,;:!?&$%#*"


class PieceTokenizer:
    """Ids of texts and of their pieces.

    ``keeps_space`` tells the two kinds apart: True where a piece carries its leading space
    (byte-level), False where white space is dropped and case is folded (word ends).
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.signs = "".join(c for c in SIGNS if not any(c in t for t in added))
        if keeps_space:  # ids whose token begins with a space, which byte-level vocabularies write as this letter
            vocab = self.tokenizer.get_vocab()
            self.begins = np.zeros(max(vocab.values()) + 1, bool)
            self.begins[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True
        # a piece between two of these is encoded as if alone
        self.mark = "\n" if keeps_space else " |\n"
        self.stop = self.tokenizer.encode(self.mark, add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts straight from the tokenizer."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def unsafe(self, piece: str) -> bool:
        """Whether a piece's white space could join with its neighbours', so that its text goes whole."""
        if not piece:
            return self.keeps_space
        body = piece[1:] if self.keeps_space and piece[0] == "\n" else piece
        return not body or (not body.isprintable() and any(c.isspace() for c in body))

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The places of the pieces in another order, their ids in a row, the number of ids of each, and how many unsafe ones are last.

        A piece has a space in front of it, but for one that begins with a line feed; unsafe ones have no ids.
        """
        kind = np.fromiter(map(str.isprintable, pieces), bool, len(pieces)).astype(np.int8)
        for k in np.flatnonzero(kind == 0).tolist():  # white space is not printable
            kind[k] = UNSAFE if self.unsafe(pieces[k]) else LINE if pieces[k][0] == "\n" else PLAIN
        if "" in pieces:
            kind[pieces.index("")] = UNSAFE if self.unsafe("") else EMPTY
        order = np.argsort(kind, kind="stable")
        plain, lines, _, odd = np.bincount(kind, minlength=UNSAFE + 1)[PLAIN:].tolist()
        own = [pieces[k] for k in order[: plain + lines].tolist()]
        parts = [self.spaced(own[:plain]) if self.keeps_space else self.joined(own[:plain], self.mark, False)]
        parts.append(self.joined(own[plain:], "", True))
        flat = [x for found in parts for x, _ in found]
        counts = np.concatenate([np.zeros(0, np.int64), *(c for found in parts for _, c in found)])
        none = np.zeros(len(order) - len(counts), np.int64)
        return order, np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate((counts, none)), odd

    def spaced(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and counts, group by group, of pieces with a space in front: the only one in a piece, and first in its token."""
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        out = []
        for group, ids in zip(groups, self.whole([" " + " ".join(g) for g in groups])):
            begins = np.flatnonzero(self.begins[ids])
            if len(begins) != len(group) or begins[0]:
                alone = self.whole([" " + p for p in group])
                out.append((np.concatenate(alone), np.array([len(x) for x in alone], np.int64)))
            else:
                out.append((ids, np.diff(begins, append=len(ids))))
        return out

    def joined(self, pieces: list[str], mark: str, leads: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and counts, group by group. The stop id ends each piece and isn't its own, or leads it and is (``leads``)."""
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        texts = [mark.join(g) + mark for g in groups]
        out = []
        for group, ids in zip(groups, self.whole(texts)):
            stops = np.flatnonzero(ids == self.stop[0])
            if len(stops) != len(group) or len(self.stop) != 1:
                alone = self.whole(group)
                out.append((np.concatenate(alone), np.array([len(x) for x in alone], np.int64)))
            elif leads:
                out.append((ids, np.diff(np.append(stops, len(ids)))))
            else:
                out.append((ids[ids != self.stop[0]], np.diff(stops, prepend=-1) - 1))
        return out
