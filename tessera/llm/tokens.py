"""Token ids of whole texts, by a vocabulary file of the tokenizers library.

The library is slow on what it has met before, and texts repeat their words.
A batch of texts is cut by Arrow, or NumPy, at places where no token can cross, and
Arrow numbers the distinct pieces; a piece's ids are looked up once per batch. Pieces
are kept from batch to batch, and so are the words (the library's own cut) that new
pieces consist of; the library encodes words that are new to a worker. Texts, chunks and
words that can't be taken apart safely go to the library whole. The ids are those
that it gives for the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Chunks and words kept by a worker, under 250 MB; at so many it starts anew.
MAX_CHUNKS, MAX_WORDS = 400_000, 700_000
#: Longer chunks and words are not kept.
MAX_KEPT_CHARS = 64
#: Bytes of text taken at once, so that long texts don't add up.
GROUP_BYTES = 4_000_000
#: Words in one call of the library.
CALL_WORDS = 50_000

#: White space by Unicode, and what Python adds to it.
_SPACE = "\\s\\v\x1c-\x1f\u0085   -     　"


class ChunkTokenizer:
    """encode() gives the ids of texts. Special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    # -- what a vocabulary's cut decides --

    def _cut(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Chunks of each text, and which texts must not be cut."""
        raise NotImplementedError

    def _text(self, chunk: str) -> str:
        """What to encode for a chunk."""
        return chunk

    def _words(self, chunks: list[str]) -> list[list[str] | None]:
        """The words of each chunk, None for one that the library must take whole."""
        raise NotImplementedError

    def _encode_words(self, words: list[str]) -> list[bytes] | None:
        """The ids of each word by one call, None if their ends can't be told."""
        raise NotImplementedError

    # -- common --

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + GROUP_BYTES, side="right")))
            yield from self._group(texts.slice(at, end - at))
            at = end

    def _group(self, texts: pa.Array) -> Iterator[np.ndarray]:
        cut, uncut = self._cut(texts)
        numbered = cut.flatten().dictionary_encode()
        index = numbered.indices.to_numpy(zero_copy_only=False)
        lists = cut.offsets.to_numpy(zero_copy_only=False)
        lists = lists - lists[0]
        table, index = self._table(numbered.dictionary.to_pylist(), index, lists, texts)
        sizes = np.array([len(ids) for ids in table], np.int64) // 4
        data = np.frombuffer(b"".join(table), "<u4")
        starts = np.cumsum(sizes) - sizes
        # the ids of all chunks in a row, gathered by place
        own = sizes[index]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        ids = data[np.repeat(starts[index] - (ends - own), own) + np.arange(total)] if total else data[:0]
        edges = np.concatenate([[0], ends])[lists]
        whole = iter(self.whole([texts[i].as_py() for i in np.flatnonzero(uncut)]))
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            yield np.frombuffer(next(whole), "<u4") if uncut[i] else ids[a:b]

    def _table(self, chunks: list[str], index: np.ndarray, lists: np.ndarray, texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """The ids of each distinct chunk, and the number of each chunk in a row."""
        return self._look_up(chunks), index

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.chunks.get, chunks))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            if len(self.chunks) > MAX_CHUNKS:
                self.chunks.clear()
            for i, ids in zip(new, self._learn([chunks[i] for i in new]), strict=True):
                found[i] = ids
                if len(chunks[i]) <= MAX_KEPT_CHARS:
                    self.chunks[chunks[i]] = ids
        return found

    def _learn(self, chunks: list[str]) -> list[bytes]:
        parts = self._words(chunks)
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        new = list({w for words in parts if words for w in words}.difference(self.words))
        found = {}
        for i in range(0, len(new), CALL_WORDS):
            call = new[i : i + CALL_WORDS]
            found.update(zip(call, self._encode_words(call) or self.whole(call), strict=True))
        long = {w: ids for w, ids in found.items() if len(w) > MAX_KEPT_CHARS}
        self.words.update(found)
        whole = iter(self.whole([self._text(c) for c, words in zip(chunks, parts, strict=True) if words is None]))
        get = self.words.__getitem__
        out = [next(whole) if words is None else b"".join(map(get, words)) for words in parts]
        for w in long:
            del self.words[w]
        return out


class SpaceTokenizer(ChunkTokenizer):
    """For byte-level vocabularies whose words take the space before them.

    Such a space starts a word, unless it stands in a run with another space; texts
    with such runs are not cut. Chunks come without their space. A text's first
    chunk has none, so it is looked up as a word or on its own.
    """

    #: Fixed value: the cut of this kind of vocabulary.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        super().__init__(path)
        self.line = int(np.frombuffer(self.whole(["\n"])[0], "<u4")[0])

    def _cut(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        uncut = pc.match_substring_regex(texts, f" [{_SPACE}]* ").to_numpy(zero_copy_only=False)
        return pc.split_pattern(pc.if_else(pa.array(uncut), "", texts), " "), uncut

    def _table(self, chunks, index, lists, texts):
        firsts = [chunks[i] for i in index[lists[:-1]].tolist()]
        heads = sorted(set(firsts))
        at = {c: len(chunks) + i for i, c in enumerate(heads)}
        index = index.copy()
        index[lists[:-1]] = [at[c] for c in firsts]
        words = [self.PATTERN.findall(c) for c in heads]
        return self._look_up(chunks) + [b"".join(self._known(w) for w in ws) for ws in words], index

    def _known(self, word: str) -> bytes:
        return self.words.get(word) or self.whole([word])[0]

    def _text(self, chunk: str) -> str:
        return " " + chunk

    def _words(self, chunks: list[str]) -> list[list[str] | None]:
        find = self.PATTERN.findall
        return [find(" " + c) for c in chunks]

    def _encode_words(self, words: list[str]) -> list[bytes] | None:
        # a line end before a word is a token of its own
        plain = [w for w in words if w.removeprefix(" ").split() == [w.removeprefix(" ")]]
        data = np.array(self.library.encode_batch_fast(["\n".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(data == self.line)
        if len(cuts) != max(len(plain) - 1, 0):
            return None
        found = dict(zip(plain, _pieces(data, np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])), strict=False))
        others = [w for w in words if w not in found]
        found.update(zip(others, self.whole(others), strict=True))
        return [found[w] for w in words]


class WordTokenizer(ChunkTokenizer):
    """For vocabularies of lower-case words with an end mark, which drop white space.

    Texts are cut at ASCII white space. What stands between is cut on into words, by
    the kinds of its bytes, if it has Latin characters only, on which lower case and
    normal forms are plain, and no apostrophe; it stays whole if not. These units are
    kept by number, with their ids in one row.
    """

    #: Fixed value: the cut of this kind of vocabulary.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    _PLAIN = regex.compile("[\x21-\x7e\xa1-įı-ž]+")
    _SPACE, _LETTER, _NUMBER, _SIGN, _OTHER = range(5)

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        kinds = np.array([self._kind(chr(c)) for c in range(0x180)], np.uint8)
        # by byte, and by character for those of two bytes from U+0080 on
        self.byte_kinds, self.kinds = np.full(256, self._OTHER, np.uint8), kinds
        self.byte_kinds[:128] = kinds[:128]
        self.numbers: dict[bytes, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _kind(self, c: str) -> int:
        if c in " \t\n\v\f\r":
            return self._SPACE
        if c == "'" or not self._PLAIN.fullmatch(c):
            return self._OTHER
        return self._LETTER if regex.match(r"\p{L}", c) else self._NUMBER if regex.match(r"\p{N}", c) else self._SIGN

    def _units(self, data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Units of texts that lie in data from edge to edge; the first of each text; which are not single words."""
        kind = self.byte_kinds[data]
        two = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
        if len(two):
            two = two[data[np.minimum(two + 1, len(data) - 1)] >> 6 == 2]
            kind[two] = self.kinds[(data[two].astype(np.int64) & 0x1F) << 6 | data[two + 1] & 0x3F]
            kind[two + 1] = kind[two]
        own = kind != self._SPACE
        first = own.copy()  # of what stands between white space
        first[1:] &= ~own[:-1]
        begins = kind == self._NUMBER
        begins[1:] |= kind[1:] != kind[:-1]
        begins[two + 1] = False
        heads = edges[:-1][edges[:-1] < edges[1:]]
        for flags in (first, begins):
            flags[heads] = True
        first &= own
        begins = (begins | first) & own
        at = np.flatnonzero(begins)
        mixed = kind[at] == self._OTHER  # a run of one kind has a unit at its begin
        if mixed.any():
            leads = first[at]
            chunk = np.cumsum(leads) - 1
            mixed = np.bincount(chunk, mixed)[chunk] > 0
            begins[at[mixed & ~leads]] = False
            at, mixed = at[leads | ~mixed], mixed[leads | ~mixed]
        packed = data[own]
        offsets = np.append(np.flatnonzero(begins[own]), len(packed)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        return units, np.searchsorted(at, edges), mixed

    def _group(self, texts: pa.Array) -> Iterator[np.ndarray]:
        _, offsets, values = texts.buffers()
        edges = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(values, np.uint8, edges[-1] - edges[0], edges[0]) if edges[-1] > edges[0] else np.zeros(0, np.uint8)
        units, lists, mixed = self._units(data, edges - edges[0])
        numbered = units.dictionary_encode()
        index = numbered.indices.to_numpy(zero_copy_only=False)
        # by one string: a list of Arrow's values takes several times as long
        lone = pa.ListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary)
        known = pc.binary_join(lone, pa.scalar(b" ", pa.large_binary()))[0].as_py().split(b" ") if len(index) else []
        ids, edges = self._gather(known, index, mixed)
        for a, b in zip(edges[lists[:-1]].tolist(), edges[lists[1:]].tolist(), strict=True):
            yield ids[a:b]

    def _gather(self, units: list[bytes], index: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in a row, by their places in units, and where each unit's begin."""
        if len(self.numbers) > MAX_WORDS:
            self.numbers.clear()
        base = len(self.numbers)
        rows = np.fromiter(map(self.numbers.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(rows < 0)
        starts, sizes, ids = self.starts[:base], self.sizes[:base], self.ids
        if len(new):
            # units that are not kept come last
            long = np.array([len(units[i]) > MAX_KEPT_CHARS for i in new.tolist()])
            new = np.concatenate([new[~long], new[long]])
            kinds = np.zeros(len(units), bool)
            kinds[index[mixed]] = True
            found = self._learn_units([units[i] for i in new.tolist()], kinds[new])
            more = np.array([len(i) for i in found], np.int64) // 4
            end = int(starts[-1] + sizes[-1]) if base else 0
            starts, sizes = np.concatenate([starts, end + np.cumsum(more) - more]), np.concatenate([sizes, more])
            ids = np.concatenate([ids[:end], np.frombuffer(b"".join(found), "<u4")])
            rows[new] = base + np.arange(len(new))
            kept = base + int((~long).sum())
            self.numbers.update(zip([units[i] for i in new[: kept - base].tolist()], range(base, kept), strict=True))
            self.starts, self.sizes, self.ids = starts[:kept], sizes[:kept], ids
        own = sizes[rows][index]
        edges = np.concatenate([[0], np.cumsum(own)])
        return ids[np.repeat(starts[rows][index] - edges[:-1], own) + np.arange(edges[-1])], edges

    def _learn_units(self, units: list[bytes], mixed: np.ndarray) -> list[bytes]:
        text = b" ".join(units).decode()
        chunks, words = text.split(" "), text.lower().split(" ")
        mixed = np.flatnonzero(mixed).tolist()
        parts = dict(zip(mixed, self._words([chunks[i] for i in mixed]), strict=True))
        single = words if not mixed else [w for i, w in enumerate(words) if i not in parts]
        need = set(single).union(*(p for p in parts.values() if p))
        found = {}
        for word in need.difference(chunks):  # what is in chunks is new
            row = self.numbers.get(word.encode())
            if row is not None:
                start = self.starts[row]
                found[word] = self.ids[start : start + self.sizes[row]].tobytes()
        new = list(need.difference(found))
        for i in range(0, len(new), CALL_WORDS):
            call = new[i : i + CALL_WORDS]
            found.update(zip(call, self._encode_words(call) or self.whole(call), strict=True))
        whole = iter(self.whole([chunks[i] for i in mixed if parts[i] is None]))
        for i in mixed:
            words[i] = f"{chunks[i]} "  # no word has a space
            found[words[i]] = next(whole) if parts[i] is None else b"".join(map(found.__getitem__, parts[i]))
        return list(map(found.__getitem__, words))

    def _words(self, chunks: list[str]) -> list[list[str] | None]:
        find, plain = self.PATTERN.findall, self._PLAIN.fullmatch
        return [find(c.lower()) if plain(c) else None for c in chunks]

    def _encode_words(self, words: list[str]) -> list[bytes] | None:
        data = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[data]) + 1
        if len(ends) != len(words):
            return None
        return _pieces(data, np.concatenate([[0], ends[:-1]]), ends)


def _pieces(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = ids.tobytes()
    return [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


@lru_cache(maxsize=4)
def tokenizer(kind: type[ChunkTokenizer], path: str) -> ChunkTokenizer:
    """One per worker, kept from task to task."""
    return kind(path)
