"""SentencePiece sampling encoder and lossless decoder.

A text is cut into segments that no piece of the vocabulary spans (a run of
space marks with the characters behind it, and line feeds). For each distinct
segment the piece lattice is filtered forward once: every edge into a position
gets its probability given that position. Every occurrence then samples its
own segmentation backward from the end, all occurrences of a batch at once.
The random numbers are a hash of seed, row key, segment number and step, so a
row's segmentation depends on nothing but its key and text: batches, partitions
and repeated tasks do not change it.

Piece weights are ``p ** alpha``: exp(score) for a unigram vocabulary; for a
BPE vocabulary, whose scores are merge ranks, 1 / (1 + rank). ``alpha`` is the
smoothing of subword regularisation: large values approach the best
segmentation, 0 samples uniformly from the lattice.

Decoding gives back the exact text: characters without a piece, and space
marks that stand in the text itself, are encoded as their UTF-8 bytes.

Edge cases: null and empty texts have no ids and decode to the empty text;
repeated rows get equal ids; a null key counts as the text ``None``; very long
texts and segments are encoded whole, in memory proportional to their length;
extra columns are carried only where named.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphsift.llm.common import id_and, in_slices

MARK = "▁"
OWN_MARK = "\udfff"         # a mark that stands in the text; no valid text holds this character
SEGMENT = re.compile(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
KNOWN_SEGMENTS = 320_000    # lattices that a task keeps
SHORT = 48                  # longest segment that is filtered together with others
TINY, HUGE = 1e-200, 1e200


def _pieces(model_file: str) -> tuple[list[tuple[int, str, float]], dict[int, int], list[bytes]]:
    """Ordinary pieces (id, piece, score), ids of the byte pieces, and the
    bytes that each id stands for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    normal, byte_id, as_bytes = [], {}, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            as_bytes.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            as_bytes.append(b"")
        else:
            as_bytes.append(piece.replace(MARK, " ").encode())
            normal.append((i, piece, model.get_score(i)))
    return normal, byte_id, as_bytes


class Vocabulary:
    """Pieces of a model file with their sampling weights."""

    def __init__(self, model_file: str, alpha: float = 1.0):
        normal, self.byte_id, self.as_bytes = _pieces(model_file)
        if len(self.byte_id) < 256:
            raise ValueError("the vocabulary has no byte pieces, so it cannot be lossless")
        if any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("a piece of the vocabulary spans a space")
        ranks = all(s <= 0 and s == round(s) for _, _, s in normal)
        last = -min(s for _, _, s in normal if s > -1e8) + 1      # user-defined pieces have no rank
        weight = (lambda s: 1 / (1 + min(-s, last))) if ranks else np.exp
        self.weights = {p: (i, float(weight(s)) ** alpha) for i, p, s in normal}
        self.byte_weight = min(w for _, w in self.weights.values())
        self.longest = max(len(p) for p in self.weights)


def _raw(char: str) -> bytes:
    return (MARK if char == OWN_MARK else char).encode()


class SuffixTrie:
    """Pieces spelled backward, as a table of states by character class.

    The most frequent characters of the vocabulary have a class each; a walk
    that meets any other character asks the dictionary of the rest."""

    CLASSES = 160

    def __init__(self, weights: dict[str, tuple[int, float]]):
        used = Counter(c for p in weights for c in p)
        chars = [c for c, _ in used.most_common(self.CLASSES - 2)]
        self.class_of = {c: i + 1 for i, c in enumerate(chars)}     # class 0: every other character
        states, rare, ends = {"": 0}, {}, [(-1, 0.0)]
        step: list[tuple[int, int, int]] = []
        for piece, (number, weight) in weights.items():
            at, spelled = 0, ""
            for c in reversed(piece):
                spelled += c
                if spelled not in states:
                    states[spelled] = len(ends)
                    ends.append((-1, 0.0))
                    if c in self.class_of:
                        step.append((at, self.class_of[c], states[spelled]))
                    else:
                        rare[at, c] = states[spelled]
                at = states[spelled]
            ends[at] = (number, weight)
        self.dead = len(ends)
        self.next = np.full((self.dead + 1, self.CLASSES), self.dead, np.int32)
        for a, c, b in step:
            self.next[a, c] = b
        self.rare = rare
        self.piece = np.array([e[0] for e in ends] + [-1], np.int32)
        self.weight = np.array([e[1] for e in ends] + [0.0])
        self.lookup = np.zeros(0x110000, np.uint8)
        for c, k in self.class_of.items():
            self.lookup[ord(c)] = k

    def walk(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        kind = self.lookup[codes]
        out = self.next[state, kind]
        for k in np.flatnonzero((kind == 0) & (state != self.dead)):
            out[k] = self.rare.get((int(state[k]), chr(codes[k])), self.dead)
        return out


class Lattices:
    """Forward-filtered lattices of distinct segments, as flat arrays.

    A node is a position of a segment; its edges are those from ``first[node]``
    up to ``first[node + 1]``. Edge arrays hold cumulated
    probability, piece and the node before. A piece below zero stands for the
    bytes of the character -piece - 1."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.trie = vocabulary, SuffixTrie(vocabulary.weights)
        self.clear()

    def clear(self) -> None:
        self.end_node: dict[str, int] = {}
        self.n_nodes = self.n_edges = 0
        self.first = np.zeros(1 << 16, np.int32)
        self.before, self.piece = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)
        self.upto = np.zeros(1 << 18, np.float32)

    def _room(self, nodes: int, edges: int) -> None:
        """Let the arrays hold so many more, growing by half."""
        for name, need in (("first", self.n_nodes + nodes + 1), ("before", self.n_edges + edges),
                           ("piece", self.n_edges + edges), ("upto", self.n_edges + edges)):
            have = getattr(self, name)
            if need > len(have):
                more = np.zeros(max(need, len(have) * 3 // 2), have.dtype)
                more[:len(have)] = have
                setattr(self, name, more)

    def _append(self, first: list, before: list, piece: list, upto: list) -> None:
        """``first`` has the ends of the new nodes' edges, counted from the old edges."""
        self._room(sum(map(len, first)), sum(map(len, piece)))
        old = self.n_edges
        for ends in first:
            self.first[self.n_nodes + 1:self.n_nodes + 1 + len(ends)] = np.asarray(ends, np.int32) + np.int32(old)
            self.n_nodes += len(ends)
        for b, p, u in zip(before, piece, upto, strict=True):
            at = slice(self.n_edges, self.n_edges + len(p))
            self.before[at], self.piece[at], self.upto[at] = b, p, u
            self.n_edges += len(p)

    def add_all(self, segments: list[str]) -> None:
        """Filter new, distinct segments."""
        short = sorted((s for s in segments if len(s) <= SHORT), key=len, reverse=True)
        for start in range(0, len(short), 1 << 16):
            self._add_short(short[start:start + (1 << 16)])
        for s in segments:
            if len(s) > SHORT:
                self._add_long(s)

    def _add_short(self, segments: list[str]) -> None:
        """All segments at once, position by position. They come longest first,
        so those that reach a position are the first so many."""
        vocabulary, trie, longest = self.vocabulary, self.trie, self.vocabulary.longest
        lengths = np.array([len(s) for s in segments])
        most = int(lengths[0])
        codes = np.frombuffer("".join(s.ljust(most, "\0") for s in segments).encode("utf-32-le", "surrogatepass"),
                              np.uint32).reshape(len(segments), most).T.copy()
        reach = [int((lengths >= j).sum()) for j in range(most + 1)]
        node = self.n_nodes + np.cumsum([0, *reach])      # first node of each position
        alpha = [np.ones(len(segments))]
        first, before, piece, upto, edges = [np.zeros(reach[0], np.int32)], [], [], [], 0
        for j in range(1, most + 1):
            n = reach[j]
            total, state, alive = np.zeros(n), np.zeros(n, np.int32), np.arange(n)
            seen, found = np.zeros(n, np.int32), []
            for size in range(1, min(j, longest) + 1):
                state = trie.walk(state, codes[j - size, alive])
                live = state != trie.dead
                state, alive = state[live], alive[live]
                if not len(alive):
                    break
                is_piece = trie.piece[state] >= 0
                who, at = alive[is_piece], state[is_piece]
                total[who] += alpha[j - size][who] * trie.weight[at]
                found.append((who, trie.piece[at], total[who], seen[who].copy(), size))
                seen[who] += 1
            bare = np.ones(n, bool)
            if found and found[0][4] == 1:
                bare[found[0][0]] = False
            for who in np.flatnonzero(bare):                     # a character without a piece
                char = segments[who][j - 1]
                raw = _raw(char)
                total[who] += alpha[j - 1][who] * vocabulary.byte_weight ** len(raw)
                number = vocabulary.byte_id[raw[0]] if len(raw) == 1 else -1 - ord(char)
                found.append((np.array([who]), np.array([number]), total[[who]], seen[[who]], 1))
                seen[who] += 1
            ends = np.cumsum(seen)
            starts, width = ends - seen, int(ends[-1])
            b, p, u = np.zeros(width, np.int32), np.zeros(width, np.int32), np.zeros(width, np.float32)
            for who, number, part, nth, size in found:
                slot = starts[who] + nth
                b[slot], p[slot], u[slot] = node[j - size] + who, number, part / total[who]
            u[ends - 1] = 1.0
            first.append(ends + edges)
            before.append(b)
            piece.append(p)
            upto.append(u)
            edges += width
            alpha.append(total)
            for who in np.flatnonzero(total < TINY):             # only ratios within the window matter
                for k in range(max(0, j - longest), j + 1):
                    alpha[k][who] *= HUGE
        self._append(first, before, piece, upto)
        ends = node[lengths] + np.arange(len(segments))
        self.end_node.update(zip(segments, ends.tolist(), strict=True))

    def _add_long(self, segment: str) -> None:
        """The same for one long segment."""
        get, longest, n = self.vocabulary.weights.get, self.vocabulary.longest, len(segment)
        base = self.n_nodes
        before, piece, upto, first = [], [], [], [0]
        alpha = [1.0] + [0.0] * n
        for j in range(1, n + 1):
            total, at = 0.0, len(piece)
            for i in range(j - 1, max(0, j - longest) - 1, -1):
                number, weight = get(segment[i:j]) or (None, 0.0)
                if number is None and i == j - 1:
                    raw = _raw(segment[i])
                    weight = self.vocabulary.byte_weight ** len(raw)
                    number = self.vocabulary.byte_id[raw[0]] if len(raw) == 1 else -1 - ord(segment[i])
                if number is not None:
                    total += alpha[i] * weight
                    before.append(base + i)
                    piece.append(number)
                    upto.append(total)
            upto[at:] = [u / total for u in upto[at:-1]] + [1.0]
            alpha[j] = total
            if total < TINY:
                for i in range(max(0, j - longest), j + 1):
                    alpha[i] *= HUGE
            first.append(len(piece))
        self._append([first], [before], [piece], [upto])
        self.end_node[segment] = base + n


def _uniform(state: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit states (the splitmix64 finaliser)."""
    z = state
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(40)).astype(np.float32)) * np.float32(2.0 ** -24)


class Sampler:
    def __init__(self, vocabulary: Vocabulary, seed: int = 7):
        self.vocabulary, self.lattices, self.seed = vocabulary, Lattices(vocabulary), seed

    def encode(self, keys: list, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit."""
        if len(self.lattices.end_node) > KNOWN_SEGMENTS:
            self.lattices.clear()
        known = self.lattices.end_node
        cut = [SEGMENT.findall(MARK + t.replace(MARK, OWN_MARK).replace(" ", MARK)) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        nodes = list(map(known.get, flat))
        missing = [i for i, node in enumerate(nodes) if node is None]
        if missing:
            self.lattices.add_all(list({flat[i] for i in missing}))        # their order changes no result
            for i in missing:
                nodes[i] = known[flat[i]]
        at = np.array(nodes, np.int32)
        del flat, nodes
        counts = np.array([len(segments) for segments in cut], np.int64)
        seeds = [xxhash.xxh64_intdigest(str(key), self.seed) for key in keys]
        doc = np.repeat(np.arange(len(counts)), counts)
        number = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        state = np.array(seeds, np.uint64)[doc] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        pieces, sizes = self._sample(at, state)
        return self._per_text(pieces, sizes, doc, len(counts))

    def _sample(self, at: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of all segments: pieces in text order, and the
        number of pieces per segment."""
        first, before, piece, upto = (self.lattices.first, self.lattices.before, self.lattices.piece,
                                      self.lattices.upto)
        sizes = np.zeros(len(at), np.int64)
        active, steps = np.arange(len(at)), []
        step = 0
        while len(active):
            node = at[active]
            draw = _uniform(state[active] + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64)))
            edge = first[node].copy()
            wait = np.flatnonzero(draw >= upto[edge])       # walk along the node's few edges
            while len(wait):
                edge[wait] += 1
                wait = wait[draw[wait] >= upto[edge[wait]]]
            steps.append((active, piece[edge]))
            sizes[active] += 1
            node = before[edge]
            at[active] = node
            active = active[first[node] != first[node + 1]]     # a start node has no edges
            step += 1
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (which, found) in enumerate(steps):
            out[ends[which] - 1 - k] = found
        return out, sizes

    def _per_text(self, pieces: np.ndarray, sizes: np.ndarray, doc: np.ndarray, n_docs: int) -> list[bytes]:
        per_doc = np.bincount(doc, sizes, n_docs).astype(np.int64) if len(doc) else np.zeros(n_docs, np.int64)
        stops = np.cumsum(per_doc)
        out, start = [], 0
        for stop in stops:
            ids = pieces[start:stop]
            low = np.flatnonzero(ids < 0)
            if len(low):                            # characters that take several byte pieces
                raw = [_raw(chr(-1 - c)) for c in ids[low]]
                grow = np.ones(len(ids), np.int64)
                grow[low] = [len(r) for r in raw]
                at = np.cumsum(grow) - grow
                ids = np.repeat(ids, grow)
                for a, r in zip(at[low], raw, strict=True):
                    ids[a:a + len(r)] = [self.vocabulary.byte_id[b] for b in r]
            out.append(ids.astype("<u4").tobytes())
            start = stop
        return out


def decode_ids(ids: bytes | None, as_bytes: list[bytes]) -> str:
    """The text of little-endian unsigned 32-bit ids."""
    if not ids:
        return ""
    raw = b"".join([as_bytes[i] for i in np.frombuffer(ids, "<u4").tolist()])
    return raw[1:].decode("utf-8", "replace")       # without the space mark before the text


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0,
           seed: int = 7, keep: list[str] | None = None, sub_batch: int = 800) -> DataFrame:
    """(id, *keep, ids): a sampled segmentation of every text."""
    carried = [id_col, *(keep or [])]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in carried],
                           T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(Vocabulary(model_file, alpha), seed)
        for part in in_slices(batches, sub_batch):
            ids = sampler.encode(part.column(0).to_pylist(), part.column(len(carried)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:len(carried)], pa.array(ids, pa.binary())],
                                             names=schema.names)

    return id_and(docs, *carried, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as a further column."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_bytes = _pieces(model_file)[2]
        for batch in in_slices(batches):
            texts = [decode_ids(i, as_bytes) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
