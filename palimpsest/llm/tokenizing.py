"""Encoding with a tokenizers file that drops white space: whole texts by memo of their different words, huge ones by overlapping windows."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that the memo holds, about, and the bytes of the longest one it takes: bounds a worker's memory. What comes later
#: is encoded without being kept.
MEMO, LONGEST = 1_000_000, 64
#: New words that go to the library in one call, and how many of them in one text.
WORDS, JOINED = 20_000, 100
#: Texts longer than HUGE code points are encoded in windows that overlap.
HUGE, WINDOW, OVERLAP = 65_536, 32_768, 512

#: Letters up to U+024F but U+0130: lower case is one code point for one, and composed forms are already composed.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: A word and the ASCII marks after it, which the pre-tokenizer parts (but for the apostrophe, which may start an ending).
_PART = f"^(?P<word>[{_LETTERS}]+)(?P<marks>[!-&(-/:-@\\[-`{{-~]*)$"
_PLAIN = f"^[{_LETTERS}]+$"
_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for this file: workers are reused, and so is what they have encoded."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


class Words:
    """Different words and their ids, as columns: a million take some 30 MB."""

    def __init__(self, names: pa.Array, ids: np.ndarray, sizes: np.ndarray):
        self.names, self.ids, self.sizes = names, ids, sizes
        self.first = np.cumsum(sizes) - sizes

    def __len__(self) -> int:
        return len(self.names)

    def head(self, n: int) -> Words:
        return Words(self.names.slice(0, n), self.ids[: self.sizes[:n].sum()], self.sizes[:n])

    def more(self, other: Words) -> Words:
        return Words(pa.concat_arrays([self.names, other.names]), np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))


def _strung(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries which, one after another, and how many each has."""
    each = sizes[which]
    before = np.cumsum(each) - each
    return ids[np.repeat(first[which] - before, each) + np.arange(each.sum())], each


class Encoder:
    """Ids as the tokenizers library gives them, without added special tokens.

    The file's normaliser and pre-tokenizer never join characters across white space, so a text's ids are those of
    its parts between blanks and line feeds, in order. The library encodes each different word once; repeats are looked up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.parts = self._none()
        # ids that end a word, if the file marks them
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True

    def _none(self) -> Words:
        return Words(pa.array([], pa.string()), np.empty(0, self.kind), np.empty(0, np.int64))

    def _called(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found])

    def _encoded(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words from the library. Plain ones (letters only) are encoded many in a text, each one's last id marked as such."""
        if plain and self.ends.any():
            ids, _ = self._called([" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(words) and last[-1] == len(ids) - 1:
                return ids, np.diff(last, prepend=-1)
        return self._called(words)

    def _learn(self, words: pa.Array) -> Words:
        """Ids of words that the memo lacks, those first that it takes."""
        short, plain = pc.less_equal(pc.binary_length(words), LONGEST), pc.match_substring_regex(words, _PLAIN)
        names, ids, sizes = [], [], []
        for s in (True, False):
            for p in (True, False):
                group = words.filter(pc.and_(pc.equal(short, s), pc.equal(plain, p)))
                for i in range(0, len(group), WORDS):
                    names.append(group.slice(i, WORDS))
                    found = self._encoded(names[-1].to_pylist(), p)
                    ids.append(found[0])
                    sizes.append(found[1])
        return Words(pa.concat_arrays(names), np.concatenate(ids), np.concatenate(sizes))

    def _found(self, words: pa.Array) -> tuple[Words, np.ndarray]:
        """The memo and what it lacks of these different words, and where each word is in that."""
        place = pc.index_in(words, value_set=self.parts.names)
        if len(self.parts) >= MEMO and place.null_count > len(words) * 3 // 4:  # another kind of text than the memo is full of
            self.parts = self._none()
            place = pc.index_in(words, value_set=self.parts.names)
        if not place.null_count:
            return self.parts, place.to_numpy(zero_copy_only=False)
        lacking = pc.is_null(place)
        made = self._learn(words.filter(lacking))
        every, old = self.parts.more(made), len(self.parts)
        at = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[lacking.to_numpy(zero_copy_only=False)] = pc.index_in(words.filter(lacking), value_set=made.names).to_numpy(zero_copy_only=False) + old
        if old < MEMO:
            self.parts = every.head(old + pc.sum(pc.less_equal(pc.binary_length(made.names), LONGEST)).as_py())
        return every, at

    def ids(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else pc.fill_null(texts, "")
        if not len(column):
            return np.empty(0, self.kind), np.empty(0, np.int64)
        split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        cut = pc.extract_regex(coded.dictionary, _PART)
        # a part that isn't a word with marks after it is looked up whole
        word = pc.if_else(pc.is_valid(cut), pc.utf8_lower(pc.struct_field(cut, "word")), coded.dictionary)
        marks = pc.if_else(pc.is_valid(cut), pc.struct_field(cut, "marks"), "")
        both = pa.concat_arrays([word, marks]).dictionary_encode()
        known, place = self._found(both.dictionary)
        two = place[both.indices.to_numpy(zero_copy_only=False)].reshape(2, -1).T.ravel()
        flat, sizes = _strung(known.ids, known.first, known.sizes, two)
        sizes = sizes.reshape(-1, 2).sum(axis=1)
        line, each = _strung(flat, np.cumsum(sizes) - sizes, sizes, coded.indices.to_numpy(zero_copy_only=False))
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        return line, np.add.reduceat(each, np.cumsum(counts) - counts)

    def _starts(self, text: str, a: int, b: int) -> np.ndarray:
        """Where the tokens of text[a:b] start, as places in text."""
        return np.array([x for x, _ in self.library.encode(text[a:b], add_special_tokens=False).offsets], np.int64) + a

    def count_huge(self, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> int:
        """Tokens of a text too long to encode at once.

        A window is encoded with an overlap beyond its end, and so is the overlap alone; a token that starts at the
        same place in both, after white space, is a boundary on which both agree, since no token spans white space.
        Tokens before it count, the next window starts there. Where there is none the overlap is doubled.
        """
        total = at = 0
        while True:
            wide = overlap
            while True:
                end = at + window
                stop = min(len(text), end + wide)
                mine = self._starts(text, at, stop)
                if stop == len(text):
                    return total + len(mine)
                both = np.intersect1d(mine[mine > end], self._starts(text, end, stop))
                stable = next((p for p in both.tolist() if text[p - 1] in " \n"), None)
                if stable is not None:
                    break
                wide *= 2
            total, at = total + int((mine < stable).sum()), stable

    def counts(self, texts: list[str]) -> list[int]:
        _, n = self.ids([t if len(t) <= HUGE else "" for t in texts])
        return [k if len(t) <= HUGE else self.count_huge(t) for t, k in zip(texts, n.tolist(), strict=True)]
