"""SentencePiece encoding and decoding: the N best segmentations.

Over the lattice of pieces a forward Viterbi pass gives each position its best score from the start. These scores
are an exact heuristic for a backward A* search from the end: paths leave the queue in the order of their
total score, so the first N complete ones are the N best. No piece crosses the start of a run of word
marks or a line feed, nor a pair of characters that no piece holds, so a text's lattice is a chain of small lattices, and what
each link adds to the best path is found by its own search: for every distinct link, once per worker, A* runs to its first complete path, and the head of its queue
then tells what the next one costs. The text's N best differ from the best only in the N - 1 words where that costs least;
there the search goes on to N paths.

Scores. The model file is one of merges: its numbers are the order of the merges, not log-probabilities, and would prefer
many early pieces to one late piece. As merges are made in the order of frequency, a piece of rank r gets the log-probability of
Zipf's law, -log(1 + r) less the log of the sum over all pieces, in whole units of 1 / ``UNITS``, so that sums are exact.
The best path is the likeliest segmentation, not the one that merging yields; the README says how often they agree.
Characters without a piece become byte pieces, at a score below every piece. Decoding joins pieces and bytes.

Defined results: null and empty texts have no piece, the score 0 and one segmentation. Of words' segmentations of equal
score, that with the longer last piece comes first, then with the longer last but one, and so on; of texts',
that which differs from the best in fewer words, then whose first such word stands earlier. A text with fewer than N segmentations
returns all of them. Repeated rows and null ids are returned row by row. Empty tables give empty
results. A long text without a space is one long lattice, searched in steps that grow with its length. Other columns are not read.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import math
import re
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame

from genolake.llm.tokens import tokenizer_path

MARK = "▁"
N_BEST = 3
UNITS = 1_000_000
#: Words whose segmentations a worker remembers (a bound of memory, not of work).
REMEMBERED_WORDS = 1_200_000
WORDS = re.compile(f"\n+|{MARK}*[^{MARK}\n]+|{MARK}+")
#: The same, and closing marks apart from the letters before them, for models without a piece of both.
WORDS_AND_MARKS = re.compile(f"\n+|{MARK}*[^\\W\\d_]+(?=[{MARK}\n.,;:!?]|$)|{MARK}*[^{MARK}\n]+|{MARK}+")

_models: dict[str, "PieceModel"] = {}


class PieceModel:
    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS) -> None:
        import ahocorasick
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.sp.get_piece_size()
        self.pieces = [self.sp.id_to_piece(i) for i in range(size)]
        special = [self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i) for i in range(size)]
        ranked = sorted((i for i in range(size) if not special[i]), key=lambda i: (-self.sp.get_score(i), i))
        every = math.log(sum(1 / (1 + r) for r in range(len(ranked))))
        self.vocab = {self.pieces[i]: (i, round(UNITS * (math.log(1 + r) + every))) for r, i in enumerate(ranked)}
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(size) if self.sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        #: Finds every piece in a text, with its length, its cost (the negative score) and its ids as bytes.
        self.finder = ahocorasick.Automaton()
        for p, (i, cost) in self.vocab.items():
            self.finder.add_word(p, (len(p), cost, i.to_bytes(4, "little")))
        self.finder.make_automaton()
        self.characters = {p for p in self.vocab if len(p) == 1}
        self.unknown_cost = max(c for _, c in self.vocab.values()) + 10 * UNITS
        self.unknown_id = self.sp.unk_id()
        self.pairs = {p[i : i + 2] for p in self.vocab for i in range(len(p) - 1)}
        self.chained = not any("\n" in p or MARK in p.lstrip(MARK) for p in self.vocab)
        self.words = WORDS if any(x.isalpha() and y in ".,;:!?" for x, y in self.pairs) else WORDS_AND_MARKS
        self.remembered = remembered
        self.known: dict[str, tuple] = {}

    def fallback(self, char: str) -> bytes:
        ids = [self.byte_ids[b] for b in char.encode("utf-8")] if self.byte_ids else [self.unknown_id]
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def lattice(self, word: str) -> list[list]:
        """The edges into each position: (cost from the start through the edge, its start, its cost, its ids). Costs are negative scores."""
        edges = self.finder.iter(word)
        if not self.characters.issuperset(word):  # characters without a piece
            extra = [(k, (1, self.unknown_cost, self.fallback(c))) for k, c in enumerate(word) if c not in self.characters]
            edges = sorted([*edges, *extra], key=itemgetter(0))
        into: list[list] = [[] for _ in range(len(word) + 1)]
        best: list = [0] + [math.inf] * len(word)
        for last, (length, cost, raw) in edges:  # in the order of their ends, so the best to every start is known
            j = last + 1
            i = j - length
            through = best[i] + cost
            into[j].append((through, i, cost, raw))
            if through < best[j]:
                best[j] = through
        return into

    def search(self, word: str, n: int, paths: int | None = None) -> tuple[list[tuple[int, bytes]], int | None]:
        """The first ``paths`` (default n) of the n best (cost, ids) of one lattice, best first, and the cost of the next of the n, or None.

        A* from the end: a partial path waits with the cost of the best whole path that ends with it, which the forward costs
        tell exactly. Partial paths that wait stand for disjoint sets of whole ones, so only the n best (less
        those found) can ever be needed. Of equals the one that came last leaves first, its longest continuation before the others.
        """
        into = self.lattice(word)
        queue: list[tuple] = [(0, len(word), 0, ())]
        out: list[tuple[int, bytes]] = []
        while queue and len(out) < (paths or n):
            _, at, behind, path = queue.pop(0)
            if at == 0:
                parts = []
                while path:
                    parts.append(path[0])
                    path = path[1]
                out.append((behind, b"".join(parts)))
                continue
            room, k = n - len(out), 0
            into[at].sort()  # of equals the longest edge is first
            for through, start, cost, raw in into[at]:
                total = through + behind
                while k < len(queue) and queue[k][0] < total:
                    k += 1
                if k >= room:
                    break
                queue.insert(k, (total, start, behind + cost, (raw, path)))
                k += 1
            del queue[room:]
        return out, queue[0][0] if queue else None

    def word(self, word: str) -> tuple[int, bytes, float]:
        """(cost of the best, its ids, how much more the next best costs): little enough to remember for many words."""
        found, then = self.search(word, 2, 1)
        cost, ids = found[0]
        return cost, ids, math.inf if then is None else then - cost

    def parts(self, word: str) -> list[str]:
        """The word cut where no piece crosses, which is between characters that follow one another in no piece."""
        pairs = self.pairs
        if word[1:].isascii() and word[1:].isalpha():  # seldom cut, and need not be
            return [word]
        cuts = [0, *[i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs], len(word)]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def learn(self, word: str) -> tuple[int, bytes, float, str]:
        """What ``word`` finds, and the text that its ids decode to."""
        parts = self.parts(word)
        if len(parts) == 1:
            cost, ids, dear = self.word(word)
            back = self.decode(memoryview(ids).cast("I").tolist())
            found = cost, ids, dear, word if back == word else back
        else:
            known = self.known
            costs, ids, dear, back = zip(*[known.get(p) or self.learn(p) for p in parts], strict=True)
            found = sum(costs), b"".join(ids), min(dear), "".join(back)
        if len(self.known) < self.remembered:
            self.known[word] = found
        return found

    def lookup(self, words: list[str]) -> list:
        """(cost, ids, cost of the next best, decoded) of each."""
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            for k, e in enumerate(out):
                if e is None:
                    w = words[k]
                    if (e := known.get(w)) is None:
                        e = self.learn(w)
                    out[k] = e
        return out

    def nbest(self, text: str, n: int = N_BEST) -> list[tuple[int, bytes]]:
        """The n best segmentations of a text as (cost, little-endian 32-bit ids), best first."""
        return self.nbest_and_text(text, n)[0]

    def nbest_and_text(self, text: str, n: int = N_BEST) -> tuple[list[tuple[int, bytes]], str]:
        """The same, and what the best one decodes to; no character's bytes are in two links of the chain, so each is decoded once."""
        import numpy as np

        normal = self.sp.normalize(text) if text else ""
        words = self.words.findall(normal) if self.chained else [normal] if normal else []
        entries = self.lookup(words)
        if not entries:
            return [(0, b"")], ""
        costs, ids, dear, back = zip(*entries, strict=True)
        decoded = "".join(back)
        base = sum(costs)
        best = [(base, b"".join(ids))]
        if n == 1:
            return best, decoded
        # The k-th best differs from the best in words among those with the k - 1 smallest next-best costs.
        costs = np.array(dear)
        near = np.argsort(costs, kind="stable")[: n - 1] if len(costs) <= 64 else _smallest(costs, n - 1)
        near = sorted(int(i) for i in near if np.isfinite(costs[i]))
        all_best = {i: self.search(words[i], n)[0] for i in near}
        alternatives = [[(c - entries[i][0], k) for k, (c, _) in enumerate(all_best[i])] for i in near]
        combos = heapq.nsmallest(n, itertools.product(*alternatives), key=lambda c: (sum(x for x, _ in c), sum(k > 0 for _, k in c), [-k for _, k in c]))
        for combo in combos[1:]:
            parts = list(ids)
            for i, (_, k) in zip(near, combo, strict=True):
                parts[i] = all_best[i][k][1]
            best.append((base + sum(x for x, _ in combo), b"".join(parts)))
        return best, decoded

    def decode(self, ids) -> str:
        """Pieces in a row, bytes joined to characters, without marks (the normalised text)."""
        pieces, byte_of = self.pieces, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            return "".join([pieces[i] for i in ids])
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in byte_of:
                held.append(byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)


def _smallest(values, k: int):
    """Places of the k smallest values, ties by place."""
    import numpy as np

    bound = np.partition(values, k - 1)[k - 1]
    below = np.flatnonzero(values < bound)
    return np.concatenate([below, np.flatnonzero(values == bound)[: k - len(below)]])


def plain(normal: str) -> str:
    """The text behind a normalised one: marks are spaces, and the first is the encoder's own."""
    return normal[1:].replace(MARK, " ") if normal.startswith(MARK) else normal.replace(MARK, " ")


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
        gc.freeze()  # the model lives as long as the worker
    return _models[path]


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, decoded_sha256 string, round_trip boolean"


def encode_decode(docs: DataFrame, n: int = N_BEST, model: str | None = None) -> DataFrame:
    """Encode every text, keep its n best segmentations' scores and digests, and decode the best one."""

    def run(batches: Iterator) -> Iterator:
        import hashlib
        import zlib

        import pyarrow as pa

        pieces = piece_model(model or tokenizer_path("piece_bpe_32k.model"))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.string(), pa.bool_())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                found, back = pieces.nbest_and_text(text, n)
                back = plain(back)
                crcs = [zlib.crc32(raw) for _, raw in found]
                rows.append((doc_id, len(found[0][1]) // 4, crcs[0], [-c / UNITS for c, _ in found], crcs, hashlib.sha256(back.encode("utf-8")).hexdigest(), back == text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            gc.freeze()  # remembered words are no garbage

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
