"""Byte-level BPE ids through the ``tokenizers`` library, with a chunk cache.

``Tokenizer.encode`` on whole texts spends most of its time on words that it has
met before.  For a byte-level BPE file a word always starts at a single space, so
a text is cut there and each chunk looked up in a per-worker cache; the distinct
new chunks of many texts go through the library joined, in few calls, and the ids
that open with a space tell where each chunk begins.  The cache gives a chunk's
number; ids stand one behind the other in one array, so that they are gathered by
numbers.  Letters with marks behind them are the number of the letters and that of
the marks.  Texts that hold a special token's string, and any other kind of
tokenizer file, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strataq.llm.common import worker_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: entries (about 200 bytes each) that a worker's cache keeps, those last asked for, when it has twice as many
CACHE_ENTRIES = 200_000
#: texts, and characters about, that are encoded together; new chunks in one call of the library; words whose ids are gathered at once
TEXTS, CHARS, JOINED, GATHERED = 1024, 1 << 21, 1000, 1 << 18

#: characters that make one word wherever they stand together (an apostrophe may open a contraction)
_MARKS = ".,;:!?#$%&*"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BpeEncoder:
    """``encode_many(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: the
    string of a special token in a text is that token.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self._entries = entries

        self._tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        model = spec.get("model") or {}
        added = spec.get("added_tokens") or ()
        self._plain = (
            model.get("type") == "BPE"
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space", True)
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
        )
        self._special = tuple(a["content"] for a in added)
        vocab = model.get("vocab") or {}
        #: ids that open with a space, which byte-level BPE writes as the letter 256 + 32
        self._opens = np.zeros(1 + max([*vocab.values(), *(a["id"] for a in added)], default=0) if self._plain else 1, bool)
        if self._plain:
            self._opens[[i for t, i in vocab.items() if t[0] == chr(288)]] = True
        self._chunks: dict[str, int] = {}  # numbers of what stands between two single spaces
        self._tails: dict[str, int] = {}  # of marks behind letters
        # by number, 0 for nothing: where the ids begin, how many, and the last call that asked
        self._starts, self._sizes, self._asked = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self._letters = np.zeros(1 << 12, bool)  # whether it is of letters alone
        self._ids, self._next, self._end, self._calls = np.zeros(1 << 14, "<u4"), 1, 0, 0

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def _whole(self, text: str) -> bytes:
        return array("I", self._tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _put(self, names: list[str], ids: np.ndarray, sizes: np.ndarray, into: dict[str, int]) -> None:
        """New entries, whose ids follow each other."""
        first, end = self._next, self._end
        self._next, self._end = first + len(names), end + len(ids)
        for kept, n in (("_starts", self._next), ("_sizes", self._next), ("_asked", self._next), ("_letters", self._next), ("_ids", self._end)):
            old = getattr(self, kept)
            if n > len(old):
                setattr(self, kept, np.concatenate([old, np.zeros(max(n - len(old), len(old) // 2), old.dtype)]))
        self._ids[end : self._end] = ids
        self._sizes[first : self._next] = sizes
        self._starts[first : self._next] = end + np.cumsum(sizes) - sizes
        self._letters[first : self._next] = list(map(str.isalpha, names))
        into.update(zip(names, range(first, self._next)))

    def _taken(self, which: np.ndarray) -> np.ndarray:
        """The ids of entries, one behind the other."""
        sizes = self._sizes[which]
        ends = np.cumsum(sizes)
        return self._ids[np.repeat(self._starts[which] - ends + sizes, sizes) + np.arange(sizes.sum())]

    def _forget(self) -> None:
        """Keep the entries last asked for, ``entries`` at most."""
        asked = self._asked[: self._next]
        keep = asked > np.partition(asked, self._next - self._entries - 1)[self._next - self._entries - 1]
        keep[0] = True
        number = np.cumsum(keep) - 1
        for kind in ("_chunks", "_tails"):
            names = getattr(self, kind)
            at = np.fromiter(names.values(), np.int64, len(names))
            some = list(compress(names, keep[at].tolist()))
            setattr(self, kind, {})
            del names  # the larger one goes before the smaller one is made
            setattr(self, kind, dict(zip(some, number[at[keep[at]]].tolist())))
        ids, sizes = self._taken(np.flatnonzero(keep)), self._sizes[: self._next][keep]
        self._ids, self._sizes, self._starts, self._asked, self._letters = ids, sizes, np.cumsum(sizes) - sizes, asked[keep], self._letters[: self._next][keep]
        self._next, self._end = len(sizes), len(ids)

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks, each behind a space, into the cache."""
        for c in [c for c in chunks if " " in c]:
            ids = np.frombuffer(self._whole(" " + c), "<u4")
            self._put([c], ids, np.array([len(ids)]), self._chunks)
        chunks = [c for c in chunks if " " not in c]
        blocks = [chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED)]
        for block, got in zip(blocks, self._tok.encode_batch_fast([" " + " ".join(b) for b in blocks], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            starts = np.flatnonzero(self._opens[ids])
            if len(starts) != len(block):
                raise RuntimeError("the library's ids do not open where the chunks do")
            self._put(block, ids, np.diff(starts, append=len(ids)), self._chunks)

    def _numbers(self, chunks: list[str], marked: list[int], wholes: list[str], odd: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of chunks and of the marks behind them (0: none); those at ``odd``, which it fills, have none.

        The chunks at ``marked`` are without their marks, and in ``wholes`` with them.  Letters
        and marks behind them are two words, so that the letters are looked up alone.
        """
        known, tails = self._chunks, self._tails
        first, second = np.array(list(map(known.get, chunks, repeat(0))), np.int64), np.zeros(len(chunks), np.int64)
        bare, new, learnt = set(marked), [], []

        def strange(j: int, c: str) -> bool:
            if odd is None or c and not c[0].isspace() and not c[-1].isspace():
                return False
            odd.append(j)
            return True

        for j in np.flatnonzero(first == 0).tolist():
            c = chunks[j]
            if c.isalpha() or j not in bare and not strange(j, c):
                new.append(j)
                learnt.append(c)
        self._learn(list(dict.fromkeys(learnt)))
        first[new] = list(map(known.__getitem__, learnt))
        if marked:
            apart = self._letters[first[marked]]
            some = [w[len(chunks[j]) :] for j, w, a in zip(marked, wholes, apart.tolist()) if a]
            for tail in set(some).difference(tails):
                ids = np.frombuffer(self._whole(tail), "<u4")
                self._put([tail], ids, np.array([len(ids)]), tails)
            second[np.array(marked)[apart]] = list(map(tails.__getitem__, some))
            if len(some) < len(marked):
                rest = [(j, w) for j, w, a in zip(marked, wholes, apart.tolist()) if not a]
                first[[j for j, _ in rest]] = 0
                rest = [(j, w) for j, w in rest if w in known or not strange(j, w)]
                self._learn(list(dict.fromkeys(w for _, w in rest if w not in known)))
                first[[j for j, _ in rest]] = [known[w] for _, w in rest]
        self._asked[first] = self._asked[second] = self._calls
        return first, second

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids by text; an empty text has none.

        Texts are split and their distinct chunks numbered in Arrow, so that the
        cache is asked once a chunk and not once a word, and ids are gathered by number.
        """
        if not self._plain:
            return [self._whole(t) if t else b"" for t in texts]
        out: list = [b""] * len(texts)
        todo = []
        for i, text in enumerate(texts):
            if any(s in text for s in self._special):
                out[i] = self._whole(text)
            elif text:
                todo.append(i)
        if todo:
            self._gather(texts, todo, out)
        if self._next > 2 * self._entries:
            self._forget()
        return out

    @staticmethod
    def _strings(values: pa.LargeStringArray) -> list[str]:
        """Of chunks, none of which holds a space; many times faster than to_pylist."""
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values), pa.scalar(" ", pa.large_string()))
        return joined[0].as_py().split(" ") if len(values) else []

    def _gather(self, texts: list[str], todo: list[int], out: list) -> None:
        lists = pc.split_pattern(pa.array([texts[i] for i in todo], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        whole = coded.dictionary
        bases = pc.utf8_rtrim(whole, characters=_MARKS)
        bases = pc.if_else(pc.equal(pc.binary_length(bases), 0), whole, bases)
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(bases), pc.binary_length(whole)).to_numpy(zero_copy_only=False))
        chunks, wholes = self._strings(bases), self._strings(whole.take(pa.array(marked)))
        which, cuts = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        self._calls += 1
        # white space of more than one character stays in a chunk: the texts that hold some are cut anew
        odd: list[int] = []
        first, second = self._numbers(chunks, marked.tolist(), wholes, odd)
        again = []
        if odd:
            mark = np.zeros(len(chunks), bool)
            mark[odd] = True
            again = np.flatnonzero(np.logical_or.reduceat(mark[which], cuts[:-1])).tolist()
        parts = {k: _CUT.split(texts[todo[k]]) for k in again}
        if parts:
            more = list({c for p in parts.values() for c in p[1:]})
            bare = [b if b.isalpha() else c for c in more for b in (c.rstrip(_MARKS),)]
            at = [j for j, (b, c) in enumerate(zip(bare, more)) if len(b) < len(c)]
            a, b = self._numbers(bare, at, [more[j] for j in at])
            data, ends = self._taken(np.stack([a, b], 1).ravel()).tobytes(), (4 * np.cumsum(self._sizes[a] + self._sizes[b])).tolist()
            has = dict(zip(more, map(data.__getitem__, map(slice, [0, *ends], ends))))
            for k, (head, *rest) in parts.items():
                out[todo[k]] = self._whole(head) + b"".join(map(has.__getitem__, rest))
        # the first chunk of a text stands behind no space: entries of their own
        opening = which[cuts[:-1]]
        heads = [b"" if k in parts else self._whole(c) for k, c in enumerate(whole.take(pa.array(opening)).to_pylist())]
        which = which.copy()
        which[cuts[:-1]] = len(chunks) + np.arange(len(todo))
        flat = np.concatenate([self._taken(np.stack([first, second], 1).ravel()), np.frombuffer(b"".join(heads), "<u4")])
        sizes = np.concatenate([self._sizes[first] + self._sizes[second], np.fromiter(map(len, heads), np.int64, len(heads)) >> 2])
        starts = np.cumsum(sizes) - sizes
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[which])])
        ids = np.empty(int(ends[-1]), "<u4")
        for lo in range(0, len(which), GATHERED):
            hi = min(lo + GATHERED, len(which))
            some = which[lo:hi]
            at = np.repeat(starts[some] - ends[lo:hi], sizes[some])
            at += np.arange(ends[lo], ends[hi])
            np.take(flat, at, out=ids[ends[lo] : ends[hi]])
        bounds = ends[cuts].tolist()
        for k, i in enumerate(todo):
            if k not in parts:
                out[i] = ids[bounds[k] : bounds[k + 1]].tobytes()


def encoder(path: str, entries: int = CACHE_ENTRIES) -> BpeEncoder:
    """One encoder a worker process and file."""
    return worker_cache(("bpe", path, entries), lambda: BpeEncoder(path, entries))


def encoded(batches: Iterator[pa.RecordBatch], path: str, entries: int = CACHE_ENTRIES) -> Iterator[tuple]:
    """(key, ids) of each row of batches of keys and texts; null texts count as empty."""
    enc, keys, texts, size = encoder(path, entries), [], [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            keys.append(key)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if len(texts) >= TEXTS or size >= CHARS:
                yield from zip(keys, enc.encode_many(texts))
                keys, texts, size = [], [], 0
    yield from zip(keys, enc.encode_many(texts))
