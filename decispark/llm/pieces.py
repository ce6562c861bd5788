"""Encoding of whole columns of texts by distinct segments, shared by the two tokenizer operators.

A text is cut before every space or newline that stands between two other characters: both
tokenizers' split patterns always end a match there, so a segment encodes alike wherever it
stands. Of a batch, every distinct segment is looked up once, and the tokenizer sees only new
ones. Texts in which white space meets white space are split by the whole pattern instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text handled at a time.
SLICE = 4_000_000
#: Characters that are neither letters, digits nor white space and start no contraction: a run of them that ends a segment is a piece of its own.
MARKS = ".,;:!?*$%&#|()[]{}<>=+-/\\\"_~^@"
#: Stands for a segment that is not known yet; -1 for one where white space meets white space.
UNSEEN = -2


def pre_tokens(segment: str, findall: Callable[[str], list[str]]) -> list[str]:
    """The matches of the split pattern; a space and letters are one."""
    return [segment] if segment[0] == " " and segment[1:].isalpha() else findall(segment)


def each(word: Callable[[str], list[int]]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """word for many words: all ids in one array, and the number of ids of each."""

    def words(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = list(map(word, letters))
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    return words


class Encoder:
    """Encodes texts by a function from a piece of text to its ids.

    words gives the ids of many runs of letters that each follow a space, all in one array, and the number of ids
    of each; whole encodes a text that holds one of the special strings, which the split pattern does not cover.
    Beyond ``most`` segments only those stay that were met again, half of ``most`` at most; this changes no result.
    """

    def __init__(
        self, encode: Callable[[str], list[int]], pattern: str, most: int = 120_000, words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None, special: tuple[str, ...] = (), whole: Callable[[str], list[int]] | None = None
    ):
        self.encode_piece, self.pattern, self.most = encode, regex.compile(pattern), most
        self.encode_words, self.special, self.encode_whole = words or each(lambda w: encode(" " + w)), special, whole
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.exact: dict[str, list[int]] = {}
        self.marks: dict[str, int] = {}
        self.fresh: list[list[int]] = []
        self.n, self.used = 1, 0  # entry 0 is empty
        self.ids = np.zeros(1 << 20, np.uint32)
        self.start, self.length, self.seen = (np.zeros(1 << 18, np.int32) for _ in range(3))

    def _add(self, ids: list[int]) -> int:
        self.fresh.append(ids)
        return self.n + len(self.fresh) - 1

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Entries of sizes[i] ids each."""
        total = len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(sizes) > len(self.start):
            self.start, self.length, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.seen))
        self.ids[self.used : self.used + total] = ids
        new = slice(self.n, self.n + len(sizes))
        self.length[new], self.start[new], self.seen[new] = sizes, self.used + np.cumsum(sizes) - sizes, 0
        self.n, self.used = self.n + len(sizes), self.used + total

    def _flush(self) -> None:
        """Move the new entries into the arrays."""
        if self.fresh:
            sizes = np.fromiter(map(len, self.fresh), np.int32, len(self.fresh))
            self._append(np.fromiter(chain.from_iterable(self.fresh), np.uint32, int(sizes.sum())), sizes)
            self.fresh = []

    def _keep(self) -> None:
        """Drop all entries but those of segments that two slices of texts held since the last time."""
        names, entries = list(self.known), np.fromiter(self.known.values(), np.int32, len(self.known))
        seen = np.where(entries > 0, self.seen[entries], 0)
        least = 2
        while np.count_nonzero(seen >= least) > self.most // 2:
            least += 1
        kept = seen >= least
        entries = entries[kept]
        sizes = self.length[entries]
        ends = np.cumsum(sizes, dtype=np.int32)
        ids = self.ids[np.repeat(self.start[entries] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        self.n, self.used = 1, 0
        self._append(ids, sizes)
        self.seen[1 : self.n] = 1
        self.marks, self.known = {}, dict(zip(compress(names, kept.tolist()), range(1, self.n)))

    def _learn(self, segments: list[str]) -> None:
        """Entries of segments that follow a space and are not known yet; those of letters alone are encoded together."""
        letters = list(filter(str.isalpha, segments))
        if len(letters) < len(segments):
            for segment in segments:
                if not segment.isalpha():
                    self.known[segment] = self._other(segment)
        if letters:
            self._flush()
            self.known.update(zip(letters, range(self.n, self.n + len(letters))))
            self._append(*self.encode_words(letters))

    def _other(self, segment: str) -> int:
        """Entry of what follows a space and is not of letters alone; -1 where white space meets white space."""
        if not segment or segment[-1].isspace():
            return -1
        if segment[0] == "\n":
            return -1 if segment[1].isspace() else self._add(self.encode_piece(segment))
        return -1 if segment[0].isspace() else self._add(self.encode_piece(" " + segment))

    def _marks(self, run: str) -> int:
        entry = self.marks.get(run)
        if entry is None:
            entry = self.marks[run] = self._add(self.encode_piece(run))
        return entry

    def _without_marks(self, names: list[str], array: pa.Array) -> tuple[list[str], np.ndarray]:
        """The names, those of letters and a run of MARKS without it, and the entries of these runs (0: none)."""
        bare = pc.utf8_rtrim(array, MARKS)
        shorter = np.flatnonzero(pc.binary_length(array).to_numpy(zero_copy_only=False) > pc.binary_length(bare).to_numpy(zero_copy_only=False))
        stems = bare.take(pa.array(shorter)).to_numpy(zero_copy_only=False).tolist()
        letters = np.fromiter(map(str.isalpha, stems), bool, len(stems))
        at, stems = shorter[letters], list(compress(stems, letters.tolist()))
        words, runs = names.copy(), np.zeros(len(names), np.int32)
        for i, stem in zip(at.tolist(), stems, strict=True):
            words[i] = stem
        runs[at] = [self._marks(names[i][len(stem) :]) for i, stem in zip(at.tolist(), stems, strict=True)]
        return words, runs

    def _head(self, segment: str) -> int:
        """Entry of a text's first segment, which no space precedes."""
        if not segment:
            return 0
        return -1 if segment[-1].isspace() else self._add(self.encode_piece(segment))

    def piecewise(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            ids = self.exact.get(piece)
            if ids is None:
                ids = self.exact[piece] = self.encode_piece(piece)
            out += ids
        return out

    def _with_special(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for name in self.special:
            found |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the number of ids of each."""
        if len(self.exact) > self.most:
            self._clear()
        texts = texts.cast(pa.large_string()).fill_null("")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        firsts = ends[:-1] - ends[0]
        distinct = lists.flatten().dictionary_encode()
        codes = distinct.indices.to_numpy()
        names = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        words, runs = self._without_marks(names, distinct.dictionary)
        entries = np.fromiter(map(self.known.get, words, repeat(UNSEEN)), np.int32, len(words))
        unseen = np.flatnonzero(entries == UNSEEN).tolist()
        if unseen:
            new = [words[i] for i in unseen]
            self._learn(list(dict.fromkeys(new)))
            entries[unseen] = [self.known[w] for w in new]
        at, run = entries[codes], runs[codes]
        at[firsts] = [self._head(names[c]) for c in codes[firsts].tolist()]
        run[firsts] = 0
        special = self._with_special(texts)
        bad = np.flatnonzero((np.minimum.reduceat(at, firsts) < 0) | special) if len(firsts) else []
        if len(bad):
            last = np.append(firsts, len(at))
            for i in bad.tolist():
                at[last[i] : last[i + 1]] = run[last[i] : last[i + 1]] = 0
                at[last[i]] = self._add((self.encode_whole if special[i] else self.piecewise)(texts[i].as_py()))
        self._flush()
        ended = np.flatnonzero(run)
        at = np.insert(at, ended + 1, run[ended])
        firsts = firsts + np.searchsorted(ended, firsts)
        sizes = self.length[at]
        upto = np.cumsum(sizes, dtype=np.int32)
        place = np.repeat(self.start[at] - (upto - sizes), sizes)
        place += np.arange(len(place), dtype=np.int32)
        counts = np.add.reduceat(sizes, firsts, dtype=np.int64) if len(firsts) else np.zeros(0, np.int64)
        out = self.ids[place]
        self.seen[np.maximum(entries, 0)] += 1
        if self.n > self.most:
            self._keep()
        return out, counts

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text]))[0].tolist()


def encode_batches(batches: Iterator[pa.RecordBatch], encoder: Encoder, text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with all their ids in one array and the number of ids of each text."""
    for whole in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < whole.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + SLICE, "right")))
            batch = whole.slice(at, end - at)
            yield batch, *encoder.encode_column(batch.column(text_at))
            at = end


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
