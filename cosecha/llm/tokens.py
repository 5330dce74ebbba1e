"""Token ids of public tokenizers, word by word, with a store in each Python worker.

The tokenizer splits at blanks and its normaliser never looks across one, so a
text's ids are those of its blank-separated words, end to end.  Arrow finds
the distinct words of a batch; each worker keeps the ids of those it has met,
up to a bound, so the tokenizer itself sees a word about once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8

WORD_BPE = "word_bpe_49k.json"
# Bytes of text that are encoded together: the more, the fewer distinct words among them.
STEP_BYTES = 4 << 20
# The store is emptied beyond so many words or ids.
STORE_WORDS = 1_000_000
STORE_IDS = 16_000_000
MARKS = ".,;:!?"  # runs of these behind letters are tokens of their own
# Words of these letters alone are one piece to the tokenizer, whatever marks
# follow, and lowering them letter by letter is what its normaliser does.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿА-Яа-я]+$"
JOINED = 2_000  # words that are encoded together
WORD_END = "</w>"

_BLANKS = np.zeros(256, bool)
_BLANKS[[32, 9, 10, 13]] = True  # only these are blanks here; the tokenizer knows more

_workers: dict[str, "WordTokenizer"] = {}


def default_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All blank-separated words of a string column, and where each row's words start and end among them."""
    data, offsets = utf8(column)
    blank = _BLANKS[data]
    first, last = ~blank, ~blank
    edge = offsets[offsets < len(data)]
    inner, before = first.copy(), edge[edge > 0] - 1
    first[1:] &= blank[:-1]
    first[edge] = inner[edge]
    last[:-1] &= blank[1:]
    last[before] = inner[before]
    sizes = np.flatnonzero(last) + 1 - (starts := np.flatnonzero(first))
    bounds = np.append(0, np.cumsum(sizes)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(bounds), pa.py_buffer(data[inner].tobytes()))
    return words, np.searchsorted(starts, offsets)


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans of ``flat`` with these starts and sizes, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit numbers, four bytes each."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._clear()

    def _clear(self) -> None:
        """An empty store: its ids, and for each word its place there; place 0 is the empty word's."""
        self.place: dict[str, int] = {"": 0}
        self.ids = np.empty(0, "<u4")
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _encode_words(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words and how many each has, from one call over all: half the cost of a call for each."""
        text = " ".join(words)
        if plain:  # one piece each: their ends tell them apart
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=0)
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        at = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        first = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
        return ids, np.diff([*np.searchsorted(first, at), len(ids)])

    def _places(self, words: list[str], plain: np.ndarray) -> np.ndarray:
        """Where the store has each of these distinct words; new ones are encoded."""
        place = self.place
        out = np.array([place.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(out < 0)
        fresh, sizes = [], []
        for kind in (True, False):
            own = new[plain[new] == kind]
            for a in range(0, len(own), JOINED):
                at = own[a:a + JOINED]
                chosen = [words[k] for k in at]
                ids, n = self._encode_words(chosen, kind)
                out[at] = np.arange(len(place), len(place) + len(at))
                place.update(zip(chosen, out[at].tolist()))
                fresh.append(ids)
                sizes.append(n)
        if fresh:
            n = np.concatenate(sizes)
            ends = len(self.ids) + np.cumsum(n)
            self.ids = np.concatenate([self.ids, *fresh])
            self.starts, self.sizes = np.concatenate([self.starts, ends - n]), np.concatenate([self.sizes, n])
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column end to end, and each row's offsets (null: no ids)."""
        if len(self.place) > STORE_WORDS or len(self.ids) > STORE_IDS:
            self._clear()
        words, rows = split_words(column)
        coded = words.dictionary_encode()
        which, own = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        # Plain words are lowered and parted from the marks behind them: only
        # the bare word may be new.
        core = pc.utf8_rtrim(own, characters=MARKS)
        plain = pc.match_substring_regex(core, PLAIN)
        heads = pc.if_else(plain, pc.utf8_lower(core), own).dictionary_encode()
        head = heads.indices.to_numpy(zero_copy_only=False)
        plain = plain.to_numpy(zero_copy_only=False)
        kinds = np.zeros(len(heads.dictionary), bool)
        kinds[head] = plain
        tail_size = (pc.binary_length(own).to_numpy() - pc.binary_length(core).to_numpy()) * plain
        marked = np.flatnonzero(tail_size)
        marks = [w[-n:] for w, n in zip(own.take(pa.array(marked)).to_pylist(), tail_size[marked].tolist())]
        parts = np.zeros((len(own), 2), np.int64)
        parts[:, 0] = self._places(heads.dictionary.to_pylist(), kinds)[head]
        distinct = list(dict.fromkeys(marks))
        at = dict(zip(distinct, self._places(distinct, np.zeros(len(distinct), bool)).tolist()))
        parts[marked, 1] = [at[m] for m in marks]
        # The ids of the batch's distinct words, then of its words.
        sizes = self.sizes[parts]
        flat = ragged(self.ids, self.starts[parts].ravel(), sizes.ravel())
        size = sizes.sum(axis=1)
        start = np.cumsum(size) - size
        ids = ragged(flat, start[which], size[which])
        return ids, np.append(0, np.cumsum(size[which]))[rows]


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for ``path``, made once and kept between tasks."""
    if path not in _workers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        _workers[path] = WordTokenizer(path)
    return _workers[path]
