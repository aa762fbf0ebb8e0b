"""Byte-level BPE by speculation and verification, and its inverse.

A pre-token is first cut greedily into the longest vocabulary entries. That guess is what
merging would give if, and only if, no merge rule would have acted across one of its cuts.
Whether a rule acts across the cut between two tokens can be read off their merge histories:
walking back through both, some pair of pieces that touch at the cut would have been merged
before the pieces grew further. The walk is done for all adjacent pairs of a batch of new
pre-tokens at once with numpy. Pre-tokens with a failing pair are merged exactly.

Tasks keep what they learnt about pre-tokens; that memory is emptied at a fixed size.

Defined cases: null text is empty and has no tokens; the text of an added token stands for
that token; every row gives one row. Decoding gives back the text.
"""
from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Pre-tokens remembered by a Python worker at most.
REMEMBERED = 800_000
_NONE = np.int64(2**62)
_LATE = 2**62
#: Words of more bytes are merged with a heap.
LONG = 200
#: Words of up to so many bytes are merged many at once, those of similar length together.
WIDTHS = (8, 12, 16, 24, 40)
#: Code points that newer Unicode tables call letters or numbers, but the
#: vocabulary's pre-tokenizer does not.
LATER_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC),
    (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: A space with white space behind it.
_SPACE_RUN = regex.compile(r" \s").search


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(others)}


def pattern():
    """Fixed pattern of the vocabulary; letters and numbers are those its library knows."""
    later = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in LATER_LETTERS)
    known = f"(?:(?![{later}])"
    return regex.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?{known}\p{{L}})+| ?{known}\p{{N}})+"
        rf"| ?(?:[^\s\p{{L}}\p{{N}}]|[{later}])+|\s+(?!\S)|\s+")


class Bpe:
    """Vocabulary, merge ranks and merge histories of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(self.ids[as_bytes(a)], self.ids[as_bytes(b)]) for a, b in merges]
        self.merged = {}
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        self.rank = np.full(size, -1, dtype=np.int64)
        for rank, (a, b) in enumerate(pairs):
            whole = self.ids[self.bytes[a] + self.bytes[b]]
            self.merged.setdefault((a, b), (rank, whole))
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = a, b, rank
        codes = np.array([a * size + b for a, b in self.merged], dtype=np.int64)
        ranks = np.array([r for r, _ in self.merged.values()], dtype=np.int64)
        order = np.argsort(codes)
        self.size, self.codes, self.ranks = size, codes[order], ranks[order]
        self.made = np.full(len(pairs), -1, dtype=np.int64)
        for rank, whole in self.merged.values():
            self.made[rank] = whole
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        # A token can be proposed only if merging its bytes alone gives it.
        self.whole = {b: i for b, i in self.ids.items() if self.merge(b) == [i]}
        # Every beginning of such a token, with the token that it is itself or -1.
        self.begun = {b[:k]: -1 for b in self.whole for k in range(1, len(b))} | self.whole
        added = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.split_added = regex.compile(f"({added})").split if added else lambda t: [t]
        self.pretokens = pattern().findall
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Exact: always the earliest rule that applies, leftmost first."""
        parts = [self.ids[word[k:k + 1]] for k in range(len(word))]
        if len(parts) > LONG:
            return self._merge_long(parts)
        rule, none = self.merged.get, (_LATE, -1)
        found = [rule(p, none) for p in zip(parts, parts[1:])]
        while found:
            first = min(found)
            if first is none or first[0] == _LATE:
                break
            k = found.index(first)
            parts[k:k + 2] = [first[1]]
            del found[k]
            if k < len(found):
                found[k] = rule((parts[k], parts[k + 1]), none)
            if k:
                found[k - 1] = rule((parts[k - 1], parts[k]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of applicable rules over a linked list of parts."""
        size = len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(*self.merged[p], k, *p) for k, p in enumerate(zip(parts, parts[1:]))
                if p in self.merged]
        heap = [(rank, k, whole, a, b) for rank, whole, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, whole, a, b = heapq.heappop(heap)
            nxt = after[k]
            if parts[k] != a or nxt >= size or parts[nxt] != b:
                continue
            parts[k], parts[nxt] = whole, -1
            after[k] = after[nxt]
            if after[k] < size:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < size:
                    pair = (parts[left], parts[after[left]])
                    if pair in self.merged:
                        rank, new = self.merged[pair]
                        heapq.heappush(heap, (rank, left, new, *pair))
        return [p for p in parts if p >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of each word; short words go through their merges side by side."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        least = 0
        for width in WIDTHS:
            some = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if len(some):
                parts = self._merge_rows([words[k] for k in some.tolist()], sizes[some], width)
                for k, row in zip(some.tolist(), parts.tolist()):
                    out[k] = [p for p in row if p >= 0]
        for k in np.flatnonzero(sizes > least).tolist():
            out[k] = self.merge(words[k])
        return out

    def _merge_rows(self, words: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
        """A row of tokens per word, filled up with -1.

        In each step every word takes its earliest rule that applies, leftmost first.
        """
        at = np.arange(width + 1)
        parts = np.full((len(words), width + 1), -1, dtype=np.int64)
        parts[at < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rules = np.full((len(words), width + 1), _NONE)
        rules[:, :-1] = self.rank_of(parts[:, :-1], parts[:, 1:])
        rules[parts < 0] = _NONE
        rules[:, :-1][parts[:, 1:] < 0] = _NONE
        todo = np.arange(len(words))
        while True:
            k = rules[todo].argmin(axis=1)
            rule = rules[todo, k]
            goes = rule < _NONE
            todo, k, rule = todo[goes], k[goes], rule[goes]
            if not len(todo):
                return parts
            row, rank = parts[todo], rules[todo]
            # The last column is always free, so it fills up the row.
            row = np.take_along_axis(row, np.minimum(at + (at > k[:, None]), width), axis=1)
            rank = np.take_along_axis(rank, np.minimum(at + (at >= k[:, None]), width), axis=1)
            here = np.arange(len(todo))
            row[here, k] = self.made[rule]
            after = row[here, k + 1]
            rank[here, k] = np.where(after >= 0, self.rank_of(row[here, k], after), _NONE)
            left = np.flatnonzero(k)
            before = k[left] - 1
            rank[left, before] = self.rank_of(row[left, before], row[left, k[left]])
            parts[todo], rules[todo] = row, rank

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, size, begun = [], 0, len(word), self.begun.get
        while at < size:
            end = to = at + 1
            token = found = begun(word[at:end])
            while found is not None and end < size:
                end += 1
                found = begun(word[at:end])
                if found is not None and found >= 0:
                    token, to = found, end
            out.append(token)
            at = to
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does merging their joined bytes leave them as they are?

        ``x`` and ``y`` are the pieces that touch at the cut, from the whole tokens backwards
        in time. A piece exists until the rule that merged it into a larger piece acts; a rule
        for (x, y) that comes before both ends would have joined them. Of equal ranks the left
        place comes first, so the left piece's end counts as earlier.
        """
        x, y = a.copy(), b.copy()
        x_until = np.full(len(a), _NONE)
        y_until = np.full(len(a), _NONE)
        fine = np.ones(len(a), dtype=bool)
        todo = np.arange(len(a))
        while len(todo):
            p, q = x[todo], y[todo]
            rule = self.rank_of(p, q)
            bad = (rule < x_until[todo]) & (rule <= y_until[todo]) & (rule < _NONE)
            fine[todo[bad]] = False
            # Undo the later of the two births; bytes were never born.
            born_x, born_y = self.rank[p], self.rank[q]
            left = born_x > born_y
            right = ~left & (born_y >= 0)
            alive = ~bad & (left | right)
            move = todo[left & alive]
            x_until[move], x[move] = self.rank[x[move]], self.right[x[move]]
            move = todo[right & alive]
            y_until[move], y[move] = self.rank[y[move]], self.left[y[move]]
            todo = todo[alive]
        return fine

    def learn(self, new: list[str]) -> None:
        """Tokens of new pre-tokens: guesses, the check of all their cuts, exact merging."""
        words = [w.encode("utf-8", "surrogatepass") for w in new]
        guesses = [self.propose(w) for w in words]
        flat = np.array([t for g in guesses for t in g], dtype=np.int64)
        ends = np.cumsum([len(g) for g in guesses])
        cut = np.ones(max(len(flat) - 1, 0), dtype=bool)
        cut[ends[:-1] - 1] = False
        at = np.flatnonzero(cut)
        wrong = at[~self.compatible(flat[at], flat[at + 1])]
        wrong = np.unique(np.searchsorted(ends, wrong, side="right")).tolist()
        for k, tokens in zip(wrong, self.merge_many([words[k] for k in wrong])):
            guesses[k] = tokens
        for text, tokens in zip(new, guesses):
            self.known[text] = np.array(tokens, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> list[list[str]]:
        """Pre-tokens of each word with a space before it.

        Words have no spaces and do not begin with white space, so that in a row of them the
        pre-tokens that begin with a space are the beginnings of words.
        """
        flat = self.pretokens(" " + " ".join(words)) if words else []
        first = [k for k, token in enumerate(flat) if token[0] == " "]
        return [flat[a:b] for a, b in zip(first, first[1:] + [len(flat)])]

    def _tokens_of(self, pieces: list[list[str]]) -> list[bytes]:
        """Ids of the pieces, each given as its pre-tokens."""
        fresh = {w for words in pieces for w in words if w not in self.known}
        if fresh:
            self.learn(list(fresh))
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in pieces]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers.

        A space that no white space follows always begins a new pre-token, so texts without
        such a pair of spaces are cut there first and the pieces are remembered whole.
        """
        if len(self.known) + len(self.known_words) > REMEMBERED:
            self.known.clear()
            self.known_words.clear()
        words = self.known_words
        plan, whole, fresh = [], [], set()
        for text in texts:
            for k, part in enumerate(self.split_added(text)):
                if k % 2:
                    plan.append(self.added[part].to_bytes(4, "little"))
                elif _SPACE_RUN(part):
                    plan.append(len(whole))
                    whole.append(self.pretokens(part))
                else:
                    pieces = part.split(" ")
                    plan.append(pieces)
                    whole.append(self.pretokens(pieces[0]))
                    fresh.update(pieces[1:])
            plan.append(None)
        fresh = [w for w in fresh if w not in words]
        if "" in fresh:
            fresh.remove("")
            words[""] = self._tokens_of([[" "]])[0]
        words.update(zip(fresh, self._tokens_of(self._words(fresh))))
        heads = iter(self._tokens_of(whole))
        out, row = [], []
        for step in plan:
            if step is None:
                out.append(b"".join(row))
                row = []
            elif isinstance(step, bytes):
                row.append(step)
            else:
                row.append(next(heads))
                if isinstance(step, list):
                    row.extend(map(words.__getitem__, step[1:]))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One vocabulary per Python worker."""
    return Bpe(path)


#: Texts whose new pre-tokens are checked together; longer ones are handled alone.
PART_CHARS = 1 << 21


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > PART_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, columns: list[str], path: str | None = None,
           with_ids: bool = True) -> DataFrame:
    """The given columns of ``docs`` and, of the column ``text``: n_tokens, ids, ids_sha256,
    decoded_sha256 (of the text that decoding the ids gives)."""
    path = path or default_path()
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, "text"])])
    kept = source.schema.names if "text" in columns else source.schema.names[:-1]
    ids_field = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([source.schema[c] for c in kept] + [
        T.StructField("n_tokens", T.LongType())] + ids_field + [
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]):
        bpe = load(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            rows = [ids for group in _groups(texts) for ids in bpe.encode_batch(group)]
            counts = [len(r) // 4 for r in rows]
            arrays = [batch[c] for c in kept] + [pa.array(counts, pa.int64())]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                flat = np.frombuffer(b"".join(rows), dtype="<i4")
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                       pa.array(flat, pa.int32())))
            arrays.append(pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()))
            arrays.append(pa.array([hashlib.sha256(bpe.decode(r)).hexdigest() for r in rows],
                                   pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the inverse of ``encode``; null ids give null."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]):
        bpe = load(path)
        for batch in batches:
            texts = [None if ids is None else
                     bpe.decode(np.array(ids, dtype="<u4").tobytes()).decode("utf-8", "replace")
                     for ids in batch["ids"].to_pylist()]
            yield pa.record_batch({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string())})

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(
        run, "doc_id long, text string")
