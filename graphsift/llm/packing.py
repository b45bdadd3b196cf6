"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document is its token ids and one end id. Its attention cost inside a
sequence is estimated as ``length + length^2 / capacity``: a linear part for
the dense layers and a quadratic one for attention within the document.
Documents shorter than a sequence are assigned whole, longest first, to the
sequence that has the lowest cost so far among those with room for them. Of
longer documents, which have to be cut, whole runs of ``capacity`` ids become
sequences of their own; their rests, and short documents that had room nowhere,
then fill what is left of the sequences, lowest cost first.

The room is planned to the token: ``total // capacity`` full sequences and,
for the rest, one short sequence per set bit of ``total % capacity``. A
sequence whose length is a power of two needs no padding, so nothing is padded
at all.

Each task packs its own documents in groups of about ``group_tokens`` tokens,
so nothing is shuffled, no key can be hot, and memory is bounded by one group
and the longest document. A group ends in at most log2(capacity) short
sequences. A sequence id is the task's partition number and a running number,
so a task that is run again gives the same ids.

Ids come from the vocabulary of the given ``tokenizers`` file. Texts without
special-token strings are encoded by the same vocabulary and merge ranks in
``tiktoken``, which gives the same ids about five times faster (tested for
every code point); texts with them go through ``tokenizers`` itself.

Edge cases: documents of equal length are assigned in the order of their rows;
a null or empty text is its end id alone; null and repeated ids are
packed row by row like any others; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphsift.llm.common import id_and, in_slices, to_arrow

END_ID = 1


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies print each byte as one visible character: the
    printable bytes as themselves, the others from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(vocabulary: str):
    """text -> np.uint32 ids, by the byte-level BPE file at ``vocabulary``."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact: list[Tokenizer] = []  # loaded when first needed
    spec = json.load(open(vocabulary, encoding="utf-8"))
    special = {t["content"] for t in spec["added_tokens"]}
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in word): rank
             for word, rank in spec["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            if not exact:
                exact.append(Tokenizer.from_file(vocabulary))
            return np.array(exact[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces of one group.

    Every token lies in exactly one piece; sequences are numbered from 0 and
    filled without gaps. Of equal lengths the document that comes first goes
    first, of equal costs the sequence with the smallest number.
    """
    pieces, short, long, n_seq = [], [], [], 0
    for doc, length in enumerate(lengths):
        for start in range(0, length - capacity + 1, capacity):
            pieces.append((doc, start, capacity, n_seq, 0))
            n_seq += 1
        if length % capacity:
            (short if length < capacity else long).append((length % capacity, doc))
    left = sum(n for n, _ in short + long)
    sizes = [capacity] * (left // capacity)
    sizes += [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (left % capacity) >> b & 1]
    rooms = dict(enumerate(sizes, n_seq))
    costs = dict.fromkeys(rooms, 0.0)

    def put(doc: int, start: int, take: int, seq: int) -> None:
        pieces.append((doc, start, take, seq, sizes[seq - n_seq] - rooms[seq]))
        rooms[seq] -= take
        costs[seq] += take + take * take / capacity

    by_cost = [(0.0, seq) for seq in rooms]         # a heap; what has too little room waits in by_room
    by_room: list[tuple[int, int]] = []
    for length, doc in sorted(short, key=lambda x: (-x[0], x[1])):
        while by_room and -by_room[0][0] >= length:
            seq = heapq.heappop(by_room)[1]
            heapq.heappush(by_cost, (costs[seq], seq))
        while by_cost and rooms[by_cost[0][1]] < length:
            seq = heapq.heappop(by_cost)[1]
            if rooms[seq]:
                heapq.heappush(by_room, (-rooms[seq], seq))
        if by_cost:
            seq = heapq.heappop(by_cost)[1]
            put(doc, 0, length, seq)
            heapq.heappush(by_cost, (costs[seq], seq))
        else:
            long.append((length, doc))              # fits nowhere
    open_seqs = [(costs[seq], seq) for seq, room in rooms.items() if room]
    heapq.heapify(open_seqs)
    for length, doc in sorted(long, key=lambda x: (-x[0], x[1])):
        start = lengths[doc] - length
        while length:
            seq = heapq.heappop(open_seqs)[1]
            take = min(length, rooms[seq])
            put(doc, start, take, seq)
            start, length = start + take, length - take
            if rooms[seq]:
                heapq.heappush(open_seqs, (costs[seq], seq))
    return pieces


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 2048, end_id: int = END_ID, group_tokens: int = 1 << 21) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row per
    piece; ``ids`` holds its token ids as little-endian unsigned 32-bit."""
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])
    kinds = [to_arrow(f.dataType) for f in schema.fields]

    def flush(keys: list, tokens: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        pieces = assign([len(t) for t in tokens], capacity)
        cols = list(zip(*[(keys[d], s, n, tokens[d][s:s + n].astype("<u4").tobytes(), len(tokens[d]), first + q, o)
                          for d, s, n, q, o in pieces], strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, kinds, strict=True)],
                                           names=schema.names)
        return batch, 1 + max(p[3] for p in pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        base = TaskContext.get().partitionId() << 32
        keys, tokens, held, used = [], [], 0, 0
        for batch in in_slices(batches):
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                keys.append(key.as_py())
                tokens.append(ids)
                held += len(ids)
                if held >= group_tokens:
                    out, n = flush(keys, tokens, base + used)
                    yield out
                    keys, tokens, held, used = [], [], 0, used + n
        if keys:
            yield flush(keys, tokens, base + used)[0]

    return id_and(docs, id_col, text_col).mapInArrow(run, schema)
