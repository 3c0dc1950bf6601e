"""Whole texts to token ids with the `tokenizers` library, one encoder per worker.

Most of a text is words seen before, so an encoder keeps the ids of space-delimited units. That is
exact for byte-level BPE: its splitting pattern always starts a new piece at a single space or a
single newline that has no white space beside it. Texts with other white space, or with the text of
an added token in them, are encoded whole.
"""

import os
import re
from array import array

import numpy as np

from .common import enter

END = 0  # closes every document
_UNITS = 1_200_000  # at so many units the memory becomes the older half, and the half before it goes
_NEWLINE = "\n"
_MARKS = ".,;:!?"
_ODD = re.compile(r"[^\S ]|  |[^a] ")  # anything but one leading space per form, joined by a letter


class Encoder:
    """Ids of texts, as the library gives them with add_special_tokens=False.

    `path` names a byte-level BPE file of the tokenizers library.
    """

    def __init__(self, path):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spanning = [t for t in self.added if re.search(r"\s", t)]  # these are in no single unit
        self.newline = self._plain(_NEWLINE)
        self.separable = len(self.newline) == 1
        self.marks = {m: array("I", self._plain(m)).tobytes() for m in _MARKS}
        self.seen, self.before = {}, {}

    def _plain(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, units):
        """Keep the ids of unseen units; False marks a unit that can't be encoded alone."""
        # Three kinds of unit: after a space, after a newline, and (a tuple) first in its text.
        forms = [u[0] if isinstance(u, tuple) else u[1:] if u[:1] == _NEWLINE else " " + u for u in units]
        joined = "a".join(forms)
        if _ODD.search(joined) or "" in forms or " " in forms or any(t in joined for t in self.added):
            good = [f.split() == [f.strip(" ")] and not any(t in f for t in self.added) for f in forms]
            self.seen.update((u, False) for u, g in zip(units, good, strict=True) if not g)
            units = [u for u, g in zip(units, good, strict=True) if g]
            forms = [f for f, g in zip(forms, good, strict=True) if g]
        # A word before one closing mark is a piece of its own, so its ids may be known already.
        left = []
        for pair in zip(units, forms, strict=True):
            unit = pair[0]
            stem = self.seen.get(unit[:-1]) if unit[-1] in _MARKS and isinstance(unit, str) and unit[-2:-1].isalpha() else None
            if stem:
                self.seen[unit] = stem + self.marks[unit[-1]]
            else:
                left.append(pair)
        units, forms = [u for u, _ in left], [f for _, f in left]
        lead = array("I", self.newline).tobytes()
        for unit, found in zip(units, self.tokenizer.encode_batch_fast(forms, add_special_tokens=False), strict=True):
            own = array("I", found.ids).tobytes()
            self.seen[unit] = lead + own if unit[0] == _NEWLINE else own

    def encode(self, texts, end=END):
        """A uint32 array of ids per text, the end id appended; a null text is empty."""
        closing = array("I", [end]).tobytes()
        if len(self.seen) > _UNITS:
            self.before, self.seen = self.seen, {}
        seen, needed, found = self.seen, set(), []
        for text in texts:
            parts = text.replace(_NEWLINE, " \n").split(" ") if text and self.separable and not any(t in text for t in self.spanning) else []
            if parts:
                parts[0] = (parts[0],)
            known = list(map(seen.get, parts))
            holes = [k for k, v in enumerate(known) if v is None]
            needed.update([parts[k] for k in holes])
            found.append((text, parts, known, holes))
        again = needed & self.before.keys()
        seen.update((u, self.before[u]) for u in again)
        self._learn(list(needed - again))
        out = []
        for text, parts, known, holes in found:
            for k in holes:
                known[k] = seen[parts[k]]
            if text and (not parts or False in known):  # encode this text whole
                raw = array("I", self._plain(text)).tobytes()
            else:
                raw = b"".join(known)
            out.append(np.frombuffer(raw + closing, dtype=np.uint32))
        return out


_encoders = {}


def encoder(path):
    """The worker's encoder for this vocabulary file; its memory goes when another operator's task begins."""
    enter("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
