"""Token ids for whole documents, used by the packing and counting operators.

The tokenizer files are public ones; their folder is a parameter and nothing is trained here.
"""

from __future__ import annotations

import base64
import itertools
import os
import unicodedata

#: Words whose ids a worker remembers; beyond it only those of the text at hand are kept (a bound of memory, with the same result).
REMEMBERED_WORDS = 400_000
#: Text that is encoded at once.
SLICE_BYTES = 2 << 20

_encoders: dict[str, "WordEncoder"] = {}
_rank_encoders: dict[str, object] = {}


def tokenizer_path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(column, most: int = SLICE_BYTES):
    """(first row, number of rows) of stretches of an Arrow string column that hold about ``most`` bytes each."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, to - at
        at, done = to, int(ends[to - 1])


def _gather(pool, begin, count):
    """(values, ends): the stretches pool[begin : begin + count] in a row, and where each ends, from 0."""
    import numpy as np

    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((begin - ends + count).astype(kind), count)
    at += np.arange(total, dtype=kind)
    return pool[at], np.append(0, ends)


class WordEncoder:
    """Ids of texts, word by word.

    It is right for tokenizers that drop white space and cut words there before anything else, so that
    a text's ids are those of its words in a row: normalisation (NFC, lower case) never works across an ASCII
    space, and special tokens hold none. Arrow tells the distinct words of a batch and cuts closing marks off, the library encodes those
    that the worker has not met, and NumPy gathers the ids of all words at once. Words that differ in ASCII case
    or in closing marks only are remembered once: such marks are tokens of their own after a letter or a digit.
    """

    MARKS = ",.;:!?"

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        import numpy as np

        self.remembered = remembered
        self.known: dict[str, int] = {}  # a word's number; its ids are pool[begin[number] : begin[number + 1]]
        self.pool, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)  # by number: whether the word was met again since it was learnt

    def _keep(self, words: list[str]) -> None:
        """Forget all known words but these and those that were met again since they were learnt, as far as there is room."""
        import numpy as np

        kept = dict.fromkeys(w for w in words if w in self.known)
        again = [w for w, i in self.known.items() if self.again[i]]
        if len(again) + len(words) <= self.remembered:
            kept |= dict.fromkeys(again)
        number = np.fromiter((self.known[w] for w in kept), np.int64, len(kept))
        self.pool, self.begin = _gather(self.pool, self.begin[number], self.begin[number + 1] - self.begin[number])
        self.known, self.again = {w: i for i, w in enumerate(kept)}, np.zeros(len(kept), bool)

    def _library(self, words: list[str]):
        """(ids, cuts) of many words at once: joined by spaces, and told apart by the places of their tokens."""
        import numpy as np

        ids, cuts, done = [], [np.zeros(1, np.int64)], 0
        for k in range(0, len(words), 2000):
            texts = words[k : k + 2000]
            encoding = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            found = np.array(encoding.ids, dtype=np.uint32)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
            at = np.fromiter((s for s, _ in encoding.offsets), np.int64, len(found))
            cuts.append(np.searchsorted(at, ends) + done)
            ids.append(found)
            done += len(found)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(cuts)

    def _parts(self, words):
        """The words as they are encoded, without their closing marks, and the marks ("" where there are none, or they stay)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.and_not(pc.string_is_ascii(words), pc.match_substring(words, "<|"))  # the strings of special tokens are left alone
        words = pc.if_else(plain, pc.ascii_lower(words), words)
        cores = pc.ascii_rtrim(words, characters=self.MARKS)
        length, left = (pc.binary_length(x).to_numpy() for x in (words, cores))
        _, ends, data = cores.buffers()
        ends = np.frombuffer(ends, np.int64)[cores.offset + 1 : cores.offset + len(cores) + 1]
        cut = (left > 0) & (left < length)
        final = np.zeros(len(cores), np.uint8)
        final[cut] = np.frombuffer(data, np.uint8)[ends[cut] - 1]
        far = np.flatnonzero(final > 127)
        cut &= np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])[final]
        # What the tokenizer makes of the last character may end in a mark, which it would join with those behind it.
        cut[far] = [unicodedata.normalize("NFC", c[-1]).lower()[-1].isalnum() for c in cores.take(pa.array(far)).to_pylist()]
        at = pa.array(cut)
        marks = [w[-n:] for w, n in zip(words.filter(at).to_pylist(), (length - left)[cut].tolist(), strict=True)]
        return pc.if_else(at, cores, words), np.flatnonzero(cut), marks

    def _learn(self, new: list[str]) -> None:
        import numpy as np

        ids, cuts = self._library(new)
        base = len(self.known)
        self.begin = np.concatenate([self.begin, cuts[1:] + len(self.pool)])
        self.pool = np.concatenate([self.pool, ids])
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        self.known.update(zip(new, range(base, base + len(new)), strict=True))

    def _numbers(self, words: list[str]):
        """The numbers of distinct words; those that are not known are learnt."""
        import numpy as np

        number = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        self.again[number[number >= 0]] = True
        if len(self.known) + len(new) > self.remembered:
            self._keep(words)
            number = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        if len(new):
            number[new] = len(self.known) + np.arange(len(new))
            self._learn([words[i] for i in new.tolist()])
        return number

    def encode(self, column):
        """(ids, cuts): the ids of an Arrow string column's rows, those of row i being ids[cuts[i] : cuts[i + 1]]."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column, "").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        starts = offsets - offsets[0]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy() if data is not None else np.zeros(0, np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        data[space] = 32
        # A word here is one with the spaces behind it, so that words lie side by side.
        first = np.concatenate([[True], space[:-1]]) & ~space
        first[starts[:-1][starts[:-1] < len(data)]] = True
        at = np.flatnonzero(first)
        words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        cores, marked, marks = self._parts(pc.ascii_rtrim(words.dictionary, characters=" "))
        parts = pa.concat_arrays([cores, pa.array(marks, pa.large_string())]).dictionary_encode()
        number = self._numbers(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
        # The ids of each distinct word: those of its core, then those of its marks.
        begin, count = np.zeros((2, len(cores), 2), np.int64)
        for column, rows, found in ((0, slice(None), number[: len(cores)]), (1, marked, number[len(cores) :])):
            begin[rows, column], count[rows, column] = self.begin[found], self.begin[found + 1] - self.begin[found]
        ids, ends = _gather(self.pool, begin.ravel(), count.ravel())
        each = words.indices.to_numpy()
        ids, ends = _gather(ids, ends[:-1:2][each], count.sum(axis=1)[each])
        return ids, ends[np.searchsorted(at, starts)]


def word_encoder(path: str) -> WordEncoder:
    """One per worker process and file, so that words stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def rank_encoder(path: str):
    """A byte-level tokenizer from a file of ranks, and the byte length of each id."""
    if path not in _rank_encoders:
        import numpy as np
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _rank_encoders[path] = (encoding, lengths)
    return _rank_encoders[path]
