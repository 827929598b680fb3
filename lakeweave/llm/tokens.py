"""Fast, exact encoding with vocabularies of the ``tokenizers`` library.

A text is cut at single spaces and line ends that stand before a character which
is not white space. Neither kind of vocabulary used here lets a token reach over
such a place, so the ids of a text are the ids of its units in order. Units repeat a
lot, so a worker keeps the ids of those it has seen, up to ``max_units``, and
asks the library only for new ones, many in one call.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import exclusive, give_back, ragged_take

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space or line end before white space or at the end: such texts are cut more carefully.
_STRANGE = r"[ \n](?:[\s\x0b\x1c-\x1f\x{85}]|\p{Z}|$)"
_CUT = re.compile(r" (?=\S)")
#: A private character, alone between spaces, marks where a unit ends.
_MARK = ""


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Encodes texts with the vocabulary at ``path``, without special tokens of its own."""

    def __init__(self, path: str, max_units: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_units = max_units
        #: In byte-level vocabularies the space is part of the unit that follows.
        self.spaced = self.tokenizer.encode("a b", add_special_tokens=False).ids != self.tokenizer.encode("a  b", add_special_tokens=False).ids
        if self.spaced:
            size = self.tokenizer.get_vocab_size()
            self.begins = np.zeros(size, bool)
            self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t[:1] in "ĠĊ"]] = True
        else:
            self.mark = np.array(self.tokenizer.encode(_MARK, add_special_tokens=False).ids)
        #: Ids of marks that may follow a word of letters; there a new token always begins.
        self.after = {c: self._plain("a" + c)[len(self._plain("a")) :] for c in ("", ".", ",")}
        self._clear()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self, keep: int = 0) -> None:
        """Forget all but the first ``keep`` units seen, which hold the frequent ones."""
        self.known: dict[str, int] = dict(zip(islice(self.known, keep), range(keep), strict=False)) if keep else {}
        if keep:
            self.flat = self.flat[: self.starts[keep]]
            self.starts, self.lengths = self.starts[:keep], self.lengths[:keep]
        else:
            self.flat, self.starts, self.lengths = array("I"), array("q"), array("q")

    def forget(self) -> None:
        """Give back what is held for units, as the worker goes on to other work."""
        self._clear()
        give_back()

    def _add(self, units: list[str], ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(units, range(n, n + len(units)), strict=True))
        self.starts.frombytes((starts + len(self.flat)).astype(np.int64).tobytes())
        self.lengths.frombytes(lengths.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        if len(self.known) != len(self.starts):
            raise ValueError("units were stored twice")

    def _plainly(self, units: list[str], texts: list[str]) -> None:
        """A call of the library for each."""
        own = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in own], np.int64)
        self._add(units, np.concatenate([*own, np.zeros(0, np.uint32)]), exclusive(sizes), sizes)

    def _compose(self, units: list[str]) -> list[str]:
        """Add words of known letters with a mark at the end; the other units are returned.

        Without spaces, letters of either case count as the same.
        """
        rest = []
        some: dict[str, tuple[list[str], list[int]]] = {c: ([], []) for c in self.after}
        for u in units:
            mark = u[-1:] if u[-1:] in self.after else ""
            stem = u[:-1] if mark else u
            if not self.spaced:
                stem = stem.lower()
            if stem is not u and (k := self.known.get(stem)) is not None and stem.isalpha() and max(stem) < "\u0250":
                some[mark][0].append(u)
                some[mark][1].append(k)
            else:
                rest.append(u)
        for c, (own, stems) in some.items():
            if own:
                at = np.array(stems, np.int64)
                flat, starts, sizes = (np.frombuffer(x, t) for x, t in ((self.flat, np.uint32), (self.starts, np.int64), (self.lengths, np.int64)))
                starts, sizes = starts[at], sizes[at]
                ids = ragged_take(flat, starts, sizes)
                del flat
                ids = np.insert(ids, np.repeat(np.cumsum(sizes), len(self.after[c])), np.tile(self.after[c], len(own)))
                sizes = sizes + len(self.after[c])
                self._add(own, ids, exclusive(sizes), sizes)
        return rest

    def _learn(self, units: list[str]) -> None:
        """Units that aren't a text's first, and so follow a space."""
        units = self._compose(units)
        for i in range(0, len(units), 2000):
            some = units[i : i + 2000]
            joined = "".join([u if u[:1] == "\n" else " " + u for u in some]) if self.spaced else (sep := f" {_MARK} ").join(some) + sep
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.uint32)
            if self.spaced:
                edges = np.flatnonzero(self.begins[ids])
                ends = np.append(edges[1:], len(ids))
            else:
                n = len(self.mark)
                hits = np.ones(max(0, len(ids) - n + 1), bool)
                for k, x in enumerate(self.mark):
                    hits &= ids[k : len(ids) - n + 1 + k] == x
                ends = np.flatnonzero(hits)
                edges = np.append(0, ends[:-1] + n) if len(ends) else ends
            if len(edges) == len(some) and (not len(edges) or edges[0] == 0):
                self._add(some, ids, edges, ends - edges)
            else:  # a unit holds the mark, or a token that looks like a start
                self._plainly(some, [" " + u if self.spaced and u[:1] != "\n" else u for u in some])

    def _places(self, units: list[str]) -> np.ndarray:
        """Where in the store each of some distinct units is; new ones are learnt."""
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        if len(new := np.flatnonzero(at < 0)):
            missing = [units[i] for i in new.tolist()]
            self._learn(missing)
            at[new] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(missing))
        return at

    def _heads(self, heads: list[str]) -> np.ndarray:
        """The same for units that begin a text, and have no space before them; they are stored with one, as no other unit is."""
        if new := [h for h in dict.fromkeys(heads) if " " + h not in self.known]:
            self._plainly([" " + h for h in new], new)
        return np.fromiter((self.known[" " + h] for h in heads), np.int64, len(heads))

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has. Null is as empty."""
        if len(self.known) > self.max_units:
            self._clear(self.max_units // 2)
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd: dict[int, np.ndarray] = {}
        if self.spaced:
            strange = pc.match_substring_regex(texts, _STRANGE)
            for i in pc.indices_nonzero(strange).to_pylist():
                head, *own = _CUT.split(texts[i].as_py())
                kinds = list(dict.fromkeys(own))
                at = dict(zip(kinds, self._places(kinds).tolist(), strict=True))
                odd[i] = np.append(self._heads([head]), np.array([at[u] for u in own], np.int64))
            if odd:
                texts = pc.if_else(strange, "", texts)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.spaced else " "), " ")
        units, edges = cut.flatten(), np.diff(cut.offsets.to_numpy()).astype(np.int64)
        begins = exclusive(edges)
        coded = units.dictionary_encode()
        index = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        if self.spaced:
            index[begins] = self._heads(units.take(pa.array(begins)).to_pylist())
        flat, starts, lengths = (np.frombuffer(x, dtype=t) if len(x) else np.zeros(0, t) for x, t in ((self.flat, np.uint32), (self.starts, np.int64), (self.lengths, np.int64)))
        if odd:
            for i, own in odd.items():
                edges[i] = len(own)
            parts = np.split(index, begins[1:])
            index = np.concatenate([odd.get(i, part) for i, part in enumerate(parts)])
        sizes = lengths[index]
        ids = ragged_take(flat, starts[index], sizes)
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(edges)]
        del flat, starts, lengths  # the arrays can't grow while a view of them lives
        return ids, np.diff(ends, prepend=0)


@functools.lru_cache(maxsize=1)
def encoder(path: str, max_units: int = 700_000) -> UnitEncoder:
    """The worker process's encoder; about 250 bytes are held for each unit."""
    return UnitEncoder(path, max_units)
