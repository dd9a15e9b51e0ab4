"""BPE encoding by speculation: greedy longest matches, vectorised checks of adjacent pairs, exact merges.

A sequence of tokens is what BPE makes of a word exactly if each token is what BPE makes of its own
string, and BPE would leave every two neighbours apart. So longest matches are proposed for whole
batches of words, all their pairs are tested with array operations, and only words with a failing pair
are merged step by step.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from pageloom.llm.chunks import Chunks, added_tokens, as_letters, load, packed
from pageloom.llm.text import map_texts

END = "</w>"
_NEVER = np.iinfo(np.int64).max


class WordBpe:
    """BPE of pieces (letters of byte-level vocabularies), given the vocabulary and the ordered merges."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.vocab, self.names = vocab, {i: t for t, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.pair_rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        left, right = np.arange(size), np.arange(size)
        order = np.full(size, -1)  # a token's place among the merges; -1: not made by one
        for r, (a, b) in enumerate(pairs):
            made = vocab[a + b]
            if order[made] < 0:
                left[made], right[made], order[made] = vocab[a], vocab[b], r
        self.left, self.right, self.order = left, right, order
        keys = np.array([a * size + b for a, b in self.pair_rank], dtype=np.int64)
        ranks = np.array(list(self.pair_rank.values()), dtype=np.int64)
        by = np.argsort(keys)
        self.size, self.keys, self.ranks = size, keys[by], ranks[by]
        self.reach: dict[str, int] = {}  # the longest token, without end mark, that begins with two letters
        for token in vocab:
            name = token.removesuffix(END)
            self.reach[name[:2]] = max(self.reach.get(name[:2], 1), len(name))
        self.whole: dict[int, bool] = {}

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of a pair among the merges; _NEVER if it is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves tokens a and b apart, for arrays of neighbours.

        Undoes the merges of both tokens from the last to the first, looking only at what touches the
        border: a merge over the border that comes before the next one undone would have been made.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        until = np.full(len(a), _NEVER)  # merges from here on are undone; ties go to the left side first
        while len(live):
            x, y = a[live], b[live]
            over = self._pair_rank(x, y)
            rx, ry = self.order[x], self.order[y]
            joins = over < until[live]
            good[live[joins]] = False
            go = ~joins & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            # a border merge of the same rank as the right token's own merge comes first, being further left
            until[live] = np.where(first, rx, ry + 1)
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
        return good

    def _letters(self, piece: str) -> list[int]:
        return [self.vocab[c] for c in piece[:-1]] + [self.vocab[piece[-1] + END]]

    def _merge(self, ids: list[int]) -> list[int]:
        """Merges in order of rank, leftmost first."""
        if len(ids) > 64:
            return self._merge_long(ids)
        get, made = self.pair_rank.get, self.made
        ranks = [get(p, _NEVER) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < _NEVER:
            i = ranks.index(least)
            ids[i:i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a linked list with a heap, for pieces of any length."""
        get, n = self.pair_rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(get(p), i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pair_rank]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (ids[p], ids[q]) in self.pair_rank:
                    heapq.heappush(heap, (get((ids[p], ids[q])), p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def exact(self, piece: str) -> list[int]:
        """What BPE makes of a piece, merge by merge."""
        return self._merge(self._letters(piece))

    def _greedy(self, piece: str) -> list[int]:
        """Longest tokens from the left; the last one needs the end mark."""
        vocab, reach, n, at, out = self.vocab, self.reach, len(piece), 0, []
        while n - at > 1:
            size = reach.get(piece[at:at + 2], 1)
            if size >= n - at:
                token = vocab.get(piece[at:] + END)
                if token is not None:
                    out.append(token)
                    return out
                size = n - at - 1
            while piece[at:at + size] not in vocab:
                size -= 1
            out.append(vocab[piece[at:at + size]])
            at += size
        out.append(vocab[piece[at:] + END])
        return out

    def _is_whole(self, token: int) -> bool:
        """Whether BPE makes this one token of the token's string."""
        if token not in self.whole:
            name = self.names[token]
            ids = self._letters(name[:-len(END)]) if name.endswith(END) else [self.vocab[c] for c in name]
            self.whole[token] = self._merge(ids) == [token]
        return self.whole[token]

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece."""
        proposed = list(map(self._greedy, pieces))
        lengths = np.fromiter(map(len, proposed), dtype=np.int64, count=len(pieces))
        flat = np.fromiter(chain.from_iterable(proposed), dtype=np.int64, count=int(lengths.sum()))
        word = np.repeat(np.arange(len(pieces)), lengths)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, place = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        failed = ~self.apart(pairs // self.size, pairs % self.size)[place.reshape(-1)]
        bad = set(word[inner[failed]].tolist())
        odd = [t for t in np.unique(flat).tolist() if not self._is_whole(t)]
        if odd:
            bad.update(word[np.isin(flat, odd)].tolist())
        raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends)]
        for i in bad:
            out[i] = packed(self.exact(pieces[i]))
        return out


@lru_cache(maxsize=1)
def bpe_chunks(path: str) -> Chunks:
    """Chunks encoded by WordBpe; the tokenizers library only normalises and splits unusual ones.

    Kept for a worker's next task.
    """
    tokenizer, model = load(path)
    bpe = WordBpe(model["vocab"], model["merges"])
    added = added_tokens(tokenizer)
    special = re.compile("|".join(f"({re.escape(x)})" for x in sorted(added, key=len, reverse=True)) or "(?!)")

    def words(plain: list[str]) -> list[bytes]:
        return bpe.encode(list(map(as_letters, plain)))

    def others(chunks: list[str]) -> list[bytes]:
        plan, pieces = [], []
        for chunk in chunks:
            parts = []
            for part in special.split(chunk):
                if part in added:
                    parts.append(added[part])
                elif part:
                    found = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(part))
                    parts.append((len(pieces), len(pieces) + len(found)))
                    pieces += [p for p, _ in found]
            plan.append(parts)
        made = bpe.encode(pieces)
        return [b"".join(packed([p]) if isinstance(p, int) else b"".join(made[p[0]:p[1]]) for p in parts)
                for parts in plan]

    return Chunks(words, others, added=added)


def bpe_encode(docs: DataFrame, path: str, keep=("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``keep`` and ``ids`` (array of ints) for each row of ``docs``.

    Ids are those of the tokenizers library for the file ``path`` with add_special_tokens=False, without
    truncation or padding; special tokens that stand in a text get their id. Null, empty and blank texts
    give an empty array. Rows are encoded one by one, wherever they lie: no shuffle.
    """
    def make():
        chunks = bpe_chunks(path)

        def compute(texts):
            made = chunks.encode(texts)
            ends = np.cumsum([0, *[len(x) // 4 for x in made]])
            values = pa.array(np.frombuffer(b"".join(made), dtype="<u4").astype(np.int32))
            return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)]
        return compute

    return map_texts(docs, make, "ids array<int>", keep, text)


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with a text column made from its ids, as decode(ids, skip_special_tokens=False) makes it.

    The vocabulary has no decoder, so tokens are joined by a space. Null ids stay null, no ids give an
    empty text, ids that are not in the vocabulary are left out.
    """
    schema = T.StructType([*encoded.schema.fields, T.StructField(decoded, T.StringType())])
    at = encoded.columns.index(ids)

    def run(batches):
        tokenizer, _ = load(path)
        names = pa.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())], pa.string())
        known = np.array([x is not None for x in names.to_pylist()])
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                lists = part.column(at)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.array([len(x) if x is not None else 0 for x in lists], dtype=np.int64)
                fine = (flat >= 0) & (flat < len(known))
                fine[fine] = known[flat[fine]]
                row = np.repeat(np.arange(len(sizes)), sizes)[fine]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(flat[fine])))
                texts = pc.if_else(lists.is_valid(), pc.binary_join(tokens, " "), None)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=schema.names)

    return encoded.mapInArrow(run, schema)
