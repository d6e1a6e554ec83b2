"""Alignment of two tokenizers over a corpus, with document counts of linked id pairs.

A token of A and one of B are linked where their byte ranges overlap; byte offsets where both end cut a text into groups.

Every document is encoded once, and its ids are written.  The first pass aligns the ids and keeps the distinct pairs of
linked ids.  They are dealt into buckets, and each bucket gets a minimal perfect hash; the key stored at an index verifies
a lookup.  A counting pass aligns the documents again into dense vectors indexed by hash, one a task, which are summed in
a tree of bounded fan-in.  The last pass aligns once more and looks up counts.  What a task holds, and what is broadcast
for a pass, is a block of at most BLOCK_BUCKETS buckets; more pairs take more passes, never more memory (vocabularies
bound the pairs, texts do not).

Both vocabularies never join a visible character and a following space in one token, so texts are cut there, and each
different piece of an Arrow batch is encoded once; pieces stay known to the worker up to a bound.  A is byte-level: its
ranks are read from the vocabulary file and merged by tiktoken.

Defined cases: null and empty texts, and those whose joined token bytes differ from space+text in either tokenizer, have no
tokens (zeros and an empty string instead of a hash); bytes that are no UTF-8 differ; very long texts are cut into pieces
like any other (one without spaces is one piece); repeated rows are documents of their own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.perfect_hash import PerfectHash, build
from ledgerlight.llm.textual import Words, buffers, slices
from ledgerlight.session import fresh_path, written

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BUCKET_PAIRS = 1 << 16
BLOCK_BUCKETS = 64
FAN_IN = 32
# Counting tasks hold a dense vector each, so there are not arbitrarily many of them.
COUNTING_TASKS = 8192
TEXT_BYTES = 4 << 20
ID_BYTES = 2 << 20
KNOWN_PIECES = 250_000

# Fixed value: the pre-tokenizer pattern of the byte-level vocabulary.
A_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 characters for themselves, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The bytes of every id, laid one after another."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.low = np.append(0, np.cumsum(self.size))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        many = self.size[ids]
        return self.data[np.arange(many.sum()) + np.repeat(self.low[ids] - np.cumsum(many) + many, many)]


class Pair:
    """Both tokenizers, and the ids of the pieces met so far."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{A_FILE}", encoding="utf-8") as file:
            model = json.load(file)
        letters, special = byte_letters(), {x["content"] for x in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): number for token, number in model["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("byte-level", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        at = {number: token for token, number in ranks.items()}
        self.bytes = (Vocabulary([at.get(i, b"") for i in range(max(at) + 1)]),
                      Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]))
        self.space = self.b.piece_to_id("\u2581")
        self.known: dict[bytes, tuple[bytes, bytes] | None] = {}

    def of(self, pieces: list[bytes]) -> list[tuple[bytes, bytes] | None]:
        """16-bit ids by A and by B of pieces that begin with a space; None where the bytes of either differ from the piece."""
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        if new:
            # Pieces that end in a visible character are cut from the next one by A, so they are encoded in one call.
            new.sort(key=lambda p: 0x20 < p[-1] < 0x7F)
            joined = sum(not 0x20 < p[-1] < 0x7F for p in new)
            texts = [p.decode("utf-8", "replace") for p in new]
            lengths = np.fromiter(map(len, new), np.int64, len(new))
            alone = [self.a.encode_ordinary(t) for t in texts[:joined]]
            rest = self.a.encode_ordinary("".join(texts[joined:]))
            a = np.fromiter(chain(*alone, rest), np.uint16, sum(map(len, alone)) + len(rest))
            cuts = np.searchsorted(np.cumsum(self.bytes[0].size[a[len(a) - len(rest):]]), np.cumsum(lengths[joined:]), side="right") + len(a) - len(rest)
            first_a = np.concatenate([[0], np.cumsum([len(x) for x in alone]), cuts]).astype(np.int64)
            # The processor encodes an empty text as nothing; here it stands for its space.
            lists = [x or [self.space] for x in self.b.encode([t[1:] for t in texts], num_threads=1)]
            first_b = np.append(0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))
            b = np.fromiter(chain.from_iterable(lists), np.uint16, first_b[-1])
            same = self.same(new, lengths, a, first_a, 0) & self.same(new, lengths, b, first_b, 1)
            cut = lambda ids, first: map(ids.tobytes().__getitem__, map(slice, (2 * first[:-1]).tolist(), (2 * first[1:]).tolist()))
            self.known.update(zip(new, zip(cut(a, first_a), cut(b, first_b))))
            self.known.update(dict.fromkeys(new[i] for i in np.flatnonzero(~same)))
        return [self.known[p] for p in pieces]

    def same(self, pieces: list[bytes], lengths: np.ndarray, flat: np.ndarray, first: np.ndarray, side: int) -> np.ndarray:
        """Which pieces their tokens' bytes give back."""
        vocabulary = self.bytes[side]
        ends = np.append(0, np.cumsum(vocabulary.size[flat]))[first]
        right = np.diff(ends) == lengths
        if right.all():
            wrong = vocabulary.join(flat) != np.frombuffer(b"".join(pieces), np.uint8)
            right[np.searchsorted(ends, np.flatnonzero(wrong), side="right") - 1] = False
            return right
        return right & np.array([vocabulary.join(flat[i:j]).tobytes() == p for i, j, p in zip(first[:-1].tolist(), first[1:].tolist(), pieces)], dtype=bool)


@cache
def tokenizers(folder: str) -> Pair:
    return Pair(folder)


def pieces_of(texts: pa.Array) -> Words:
    """Space+text of every text that is not empty, cut between a visible character and a space."""
    full = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary())), pa.scalar(None, pa.large_binary()))
    data, offsets = buffers(full)
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 3:
        last, second, third = data[2:-1], data[1:-2], data[:-3]
        # White space beyond ASCII is C2 85, C2 A0 or three bytes from E1, E2 or E3.
        wide = (last >= 0x80) & ~((third >= 0xE1) & (third <= 0xE3)) & ~((second == 0xC2) & ((last == 0x85) | (last == 0xA0)))
        cut[3:-1] = (data[3:] == 0x20) & (((last > 0x20) & (last < 0x7F)) | wide)
        cut[2] = data[2] == 0x20 and 0x20 < data[1] < 0x7F
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(cut[:len(data)])
    end = np.append(start[1:], len(data)) if len(start) else start
    return Words(data, start, end, np.searchsorted(start, offsets))


def ranges(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers low[i], low[i] + 1, ... of every i, many[i] of them."""
    return np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)


def encoded_slice(texts: pa.Array, pair: Pair) -> list[pa.Array]:
    """Ids by A and by B of every text, as 16-bit numbers in a binary column each; nothing for texts without tokens."""
    words = pieces_of(texts)
    one, two = words.hashes(0), words.hashes(1)
    _, at, unit = np.unique(one, return_index=True, return_inverse=True)
    if (two[at][unit] != two).any():
        _, at, unit = np.unique(np.column_stack([one, two]), axis=0, return_index=True, return_inverse=True)
    unit = unit.reshape(-1)
    found = pair.of([words.data[a:b].tobytes() for a, b in zip(words.start[at].tolist(), words.end[at].tolist())])
    sound = np.ones(len(words.first) - 1, dtype=bool)
    sound[words.rows()[np.array([x is None for x in found], dtype=bool)[unit]]] = False
    kept = np.repeat(sound, words.counts)
    unit, first = unit[kept], np.append(0, np.cumsum(np.where(sound, words.counts, 0)))
    out = []
    for side in range(2):
        ids = [x[side] if x else b"" for x in found]
        size = np.array([len(x) for x in ids], np.int64) // 2
        flat = np.frombuffer(b"".join(ids), np.uint16)
        many = size[unit]
        data = flat[ranges(np.append(0, np.cumsum(size))[unit], many)]
        edges = np.append(0, np.cumsum(many))[first] * 2
        out.append(pa.Array.from_buffers(pa.large_binary(), len(sound), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary()))
    return out


def encoded(documents: DataFrame, folder: str) -> DataFrame:
    """(doc_id, a, b): the ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(folder)
        for batch in batches:
            for low, high in text_slices(batch["text"], TEXT_BYTES):
                some = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([some["doc_id"], *encoded_slice(some["text"], pair)], ["doc_id", "a", "b"])

    out = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, a binary, b binary")
    path = fresh_path(documents.sparkSession, "token-ids")
    out.write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(out.schema).parquet(path)


def text_slices(column: pa.Array, size: int) -> list[tuple[int, int]]:
    return slices(np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))), size)


# The decimal digits of every 16-bit number and a place for what follows them.
DIGITS = np.frombuffer("".join(str(i).ljust(6) for i in range(1 << 16)).encode(), np.uint8).reshape(-1, 6)
WIDTH = np.array([len(str(i)) for i in range(1 << 16)], np.int64)


class Aligned:
    """The links of some documents: link i joins the ids keys[i] >> 16 of A and keys[i] & 0xFFFF of B; row r has links edge[r]:edge[r + 1]."""

    def __init__(self, a: pa.Array, b: pa.Array, pair: Pair):
        (data_a, first_a), (data_b, first_b) = buffers(a), buffers(b)
        self.a, self.b = np.frombuffer(data_a.tobytes(), np.uint16), np.frombuffer(data_b.tobytes(), np.uint16)
        self.first_a, self.first_b = first_a // 2, first_b // 2
        ends_a, ends_b = np.cumsum(pair.bytes[0].size[self.a]), np.cumsum(pair.bytes[1].size[self.b])
        # Every byte where a token ends closes one link, that of the tokens which cover it.
        kind = np.zeros((int(ends_a[-1]) if len(ends_a) else 0) + 1, np.uint8)
        kind[ends_a] = 1
        kind[ends_b] += 2
        at = np.flatnonzero(kind)
        kind = kind[at]
        by_a, by_b = kind & 1, kind >> 1
        self.at_a, self.at_b = np.cumsum(by_a, dtype=np.int64) - by_a, np.cumsum(by_b, dtype=np.int64) - by_b
        self.keys = self.a[self.at_a].astype(np.uint32) << np.uint32(16) | self.b[self.at_b]
        self.both = kind == 3
        self.edge = np.searchsorted(at, np.append(0, ends_a)[self.first_a], side="right")

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum over the links of every row."""
        sums = np.append(0, np.cumsum(values, dtype=np.int64))
        return sums[self.edge[1:]] - sums[self.edge[:-1]]

    def document_pairs(self) -> np.ndarray:
        """The pairs of every row, each once a row."""
        rows = np.repeat(np.arange(len(self.edge) - 1, dtype=np.uint64), np.diff(self.edge))
        return (np.unique(rows << np.uint64(32) | self.keys) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def digests(self) -> list[str]:
        """SHA-256 of the groups of every row as text."""
        last_a, last_b = self.at_a[self.both], self.at_b[self.both]
        group_a = np.repeat(np.arange(len(last_a)), np.diff(last_a, prepend=-1))
        group_b = np.repeat(np.arange(len(last_b)), np.diff(last_b, prepend=-1))
        place_a = np.arange(len(self.a)) + np.append(0, last_b + 1)[group_a]
        place_b = np.arange(len(self.b)) + (last_a + 1)[group_b]
        ids, mark = np.empty(len(self.a) + len(self.b), np.uint16), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        width, out = WIDTH[ids], DIGITS[ids]
        out[np.arange(len(ids)), width] = mark
        text = out[np.arange(6) <= width[:, None]]
        edges = np.append(0, np.cumsum(width + 1))[self.first_a + self.first_b]
        return [hashlib.sha256(text[low:high - 1]).hexdigest() if high > low else "" for low, high in zip(edges[:-1].tolist(), edges[1:].tolist())]


def aligned(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    pair = tokenizers(folder)
    for batch in batches:
        for low, high in text_slices(batch["a"], ID_BYTES):
            some = batch.slice(low, high - low)
            yield some, Aligned(some["a"], some["b"], pair)


# The bucket of a pair, in numpy and as a column: two rounds of multiplying and folding 32 bits.
FACTORS, MASK = (0x5BD1E995, 0x6C8E9CF5), 0xFFFFFFFF


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    h = keys.astype(np.uint64)
    for factor in FACTORS:
        h = (h ^ (h >> np.uint64(15))) * np.uint64(factor) & np.uint64(MASK)
    return ((h * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def bucket_column(key: Column, buckets: int) -> Column:
    h = key
    for factor in FACTORS:
        h = (h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(factor)).bitwiseAND(F.lit(MASK))
    return F.shiftright(h * F.lit(buckets), 32).cast("int")


class Block:
    """The hashes, keys and, once counted, counts of some buckets; bucket i has indexes base[i]:base[i + 1]."""

    def __init__(self, buckets: int, rows: list[tuple]):
        self.buckets = buckets
        self.numbers = {r[0]: i for i, r in enumerate(rows)}
        self.hash = PerfectHash([(np.frombuffer(r[1][0], np.int64), np.frombuffer(r[1][1], np.uint64)) for r in rows])
        keys = [np.frombuffer(r[2], np.uint32) for r in rows]
        self.base = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int64)
        self.place = np.full(buckets, -1, np.int64)
        self.place[list(self.numbers)] = list(self.numbers.values())
        self.keys = np.concatenate([*keys, np.zeros(0, np.uint32)])
        self.counts = np.concatenate([*(np.frombuffer(r[3], np.int64) for r in rows), np.zeros(0, np.int64)]) if rows and len(rows[0]) > 3 else None

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The verified index of every key; -1 for one of another block."""
        place = self.place[bucket_of(keys, self.buckets)]
        mine = place >= 0
        out = np.full(len(keys), -1, np.int64)
        out[mine] = self.hash.index(keys[mine], place[mine])
        right = out >= 0
        right[right] = self.keys[out[right]] == keys[right]
        return np.where(right, out, -1)


def distinct_pairs(documents: DataFrame, folder: str) -> DataFrame:
    """Every pair of linked ids of the corpus once, as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint32)
        for _, part in aligned(batches, folder):
            new = np.setdiff1d(part.keys, seen)
            if len(new):
                # Most pairs come again in every slice; the last ones met are remembered.
                seen = np.union1d(seen if len(seen) < (1 << 20) else seen[:0], new)
                yield pa.RecordBatch.from_arrays([pa.array(new.astype(np.int64))], ["pair"])

    return documents.select("a", "b").mapInArrow(run, "pair bigint").distinct()


def indexed(pairs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hash, keys): a minimal perfect hash a bucket, and its keys by index."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.asarray(table["pair"]).astype(np.uint32)
        sizes, words = build(keys)
        by_index = np.empty(len(keys), np.uint32)
        by_index[PerfectHash([(sizes, words)]).index(keys, np.zeros(len(keys), np.int64))] = keys
        return pa.table([table["bucket"][:1], pa.array([[sizes.tobytes(), words.tobytes()]], pa.list_(pa.binary())), pa.array([by_index.tobytes()])], ["bucket", "hash", "keys"])

    return pairs.select(bucket_column(F.col("pair"), buckets).alias("bucket"), "pair").groupBy("bucket").applyInArrow(run, "bucket int, hash array<binary>, keys binary")


def counted(documents: DataFrame, block, folder: str) -> DataFrame:
    """(bucket, part, counts): how many documents hold each pair of a block, in a dense vector for each task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, part = Block(*block.value), TaskContext.get().partitionId()
        sums = np.zeros(len(hashed.keys), np.int64)
        for _, some in aligned(batches, folder):
            index = hashed.index(some.document_pairs())
            sums += np.bincount(index[index >= 0], minlength=len(sums))
        for number, i in hashed.numbers.items():
            mine = sums[hashed.base[i]:hashed.base[i + 1]]
            if mine.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([part], pa.int32()), pa.array([mine.tobytes()])], ["bucket", "part", "counts"])

    return documents.select("a", "b").coalesce(COUNTING_TASKS).mapInArrow(run, "bucket int, part int, counts binary")


def tree_sum(counts: DataFrame) -> DataFrame:
    """One vector a bucket: sums of at most FAN_IN vectors, round by round."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["counts"])
        return pa.table([table["bucket"][:1], table["part"][:1], pa.array([total.tobytes()])], ["bucket", "part", "counts"])

    counts = written(counts, "pair-vectors")
    parts = (counts.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        counts = written(counts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("bucket", "part").applyInArrow(run, "bucket int, part int, counts binary"), "pair-vectors")
        parts = -(-parts // FAN_IN)
    return counts.select("bucket", "counts")


def pair_counts(index: DataFrame) -> DataFrame:
    """(a, b, documents) of every pair, from the rows of the index with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, counts in zip(batch["keys"], batch["counts"]):
                keys = np.frombuffer(raw.as_py(), np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> 16).astype(np.int32)), pa.array((keys & 0xFFFF).astype(np.int32)), pa.array(np.frombuffer(counts.as_py(), np.int64))], ["a", "b", "documents"])

    return index.select("keys", "counts").mapInArrow(run, "a int, b int, documents bigint")


REPORT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def looked_up(documents: DataFrame, block, best, folder: str) -> DataFrame:
    """The report of every document, with the sums over those of its links that are in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, most = Block(*block.value), np.frombuffer(best.value, np.int64)
        for batch, some in aligned(batches, folder):
            index = hashed.index(some.keys)
            count = np.where(index >= 0, hashed.counts[index], 0) if len(hashed.keys) else np.zeros(len(index), np.int64)
            top = (index >= 0) & (count == most[(some.keys >> np.uint32(16)).astype(np.int64)])
            sums = [np.diff(some.first_a), np.diff(some.first_b), some.total(some.both), np.diff(some.edge)]
            columns = [batch["doc_id"], *map(pa.array, sums), pa.array(some.digests(), pa.string()), pa.array(some.total(top)), pa.array(some.total(count))]
            yield pa.RecordBatch.from_arrays(columns, [*REPORT, "n_best", "count_sum"])

    return documents.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")


def counted_index(documents: DataFrame, folder: str = FOLDER, bucket_pairs: int = BUCKET_PAIRS, block_buckets: int = BLOCK_BUCKETS) -> tuple[DataFrame, int]:
    """(bucket, block, hash, keys, counts) of all pairs of encoded documents, and the number of buckets."""
    context = documents.sparkSession.sparkContext
    pairs = written(distinct_pairs(documents, folder), "pairs")
    buckets = -(-pairs.count() // bucket_pairs)
    index = written(indexed(pairs, max(1, buckets)).withColumn("block", F.floor(F.col("bucket") / block_buckets).cast("int")), "pair-index")
    counts = None
    for number in range(-(-buckets // block_buckets)):
        rows = [(r["bucket"], r["hash"], r["keys"]) for r in index.where(F.col("block") == number).collect()]
        block = context.broadcast((buckets, rows))
        some = tree_sum(counted(documents, block, folder))
        counts = some if counts is None else counts.union(some)
        block.destroy()
    counts = counts if counts is not None else index.select("bucket", F.col("keys").alias("counts"))
    return written(index.join(counts, "bucket"), "pair-counts"), buckets


def alignment_report(documents: DataFrame, folder: str = FOLDER, bucket_pairs: int = BUCKET_PAIRS, block_buckets: int = BLOCK_BUCKETS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row a document."""
    spark, documents = documents.sparkSession, encoded(documents, folder)
    index, buckets = counted_index(documents, folder, bucket_pairs, block_buckets)
    # One number for each id of A: bounded by its vocabulary.
    highest = pair_counts(index).groupBy("a").agg(F.max("documents").alias("most")).collect()
    most = np.zeros(1 << 16, np.int64)
    for row in highest:
        most[row["a"]] = row["most"]
    best, blocks, out = spark.sparkContext.broadcast(most.tobytes()), max(1, -(-buckets // block_buckets)), None
    for number in range(blocks):
        rows = [(r["bucket"], r["hash"], r["keys"], r["counts"]) for r in index.where(F.col("block") == number).collect()]
        block = spark.sparkContext.broadcast((max(1, buckets), rows))
        some = written(looked_up(documents, block, best, folder), "aligned")
        block.destroy()
        out = some if out is None else out.union(some)
    best.destroy()
    if blocks == 1:
        return out
    # Every row came once a block; equal rows have equal sums, so m of them in each block are m rows with an mth of the sums.
    copies = (F.count("*") / blocks).cast("int")
    each = out.groupBy(*REPORT).agg(copies.alias("copies"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    share = lambda name: F.expr(f"{name} div copies").alias(name)
    return each.select(*REPORT, share("n_best"), share("count_sum"), "copies").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")
