"""Byte-level BPE: encoding by corpus-level merge replay, and decoding."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.llm.common import fresh, query, table

#: Characters of text whose words are replayed together; memory is bounded by it and by one text.
CORPUS_CHARS = 1_500_000
#: Words of earlier corpora a task remembers with their ids.
REMEMBER = 200_000
NONE = np.int32(2**31 - 1)


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes to rank from the lines of a rank file: base64, space, rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def load_ranks(spark, path: str) -> dict[bytes, int]:
    """Ranks from a file that Spark's readers can open; a vocabulary is a bounded table."""
    return read_ranks(r.value.encode() for r in spark.read.text(path).collect())


class Vocabulary:
    """Ranks as arrays: byte to id, token bytes, and the rank of every pair that merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.size = size
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    made.append(rank)
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank that each pair of ids merges to, or NONE."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """A single word, the lowest rank first and the leftmost among equals."""
        if word in self.ranks:
            return [self.ranks[word]]
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, end to end, and the number of ids of each.

    The words lie in one array with links to the next and previous symbol. An inverted
    index holds, for each rank, the positions whose pair merges to it. Ranks are taken in
    order; every position that still has its pair merges, of overlapping ones the first,
    third and so on; then only the pairs on both sides are looked up again and entered
    into the index. A word in which a merge makes a pair of a lower rank than the one at
    hand would depend on the order inside the word, and is encoded on its own.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    token = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    # position n is a wall: it never merges
    nxt = np.append(np.arange(1, n + 1), n)
    prv = np.append(np.arange(-1, n - 1), n)
    nxt[ends[sizes > 0] - 1] = n
    prv[(ends - sizes)[sizes > 0]] = n
    token = np.append(token, -1)
    rank = np.full(n + 1, NONE, np.int32)
    inner = np.flatnonzero(nxt[:n] < n)
    rank[inner] = vocabulary.pair_ranks(token[inner], token[nxt[inner]])
    index: dict[int, list[np.ndarray]] = {}
    pending: list[int] = []

    def enter(at: np.ndarray) -> None:
        at = at[rank[at] != NONE]
        if not len(at):
            return
        by = rank[at]
        order = np.argsort(by, kind="stable")
        at, by = at[order], by[order]
        cuts = np.flatnonzero(np.diff(by)) + 1
        for part, r in zip(np.split(at, cuts), by[np.concatenate(([0], cuts))].tolist()):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(pending, r)

    enter(inner)
    odd = np.zeros(len(words), bool)
    while pending:
        r = heapq.heappop(pending)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[rank[at] == r]
        if len(at) > 1:
            chained = np.concatenate(([False], nxt[at[:-1]] == at[1:]))
            if chained.any():
                begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        side = np.flatnonzero(after[:-1] == at[1:])  # merges side by side: the left one alone may make a lower pair
        if len(side):
            for_a_while = vocabulary.pair_ranks(np.full(len(side), r), token[after[side]])
            odd[word[at[side[for_a_while < r]]]] = True
        token[at], token[gone] = r, -1
        rank[gone] = NONE
        nxt[at] = after
        inside = after < n
        prv[after[inside]] = at[inside]
        before = prv[at]
        touched = np.unique(np.concatenate((at, before[before < n])))
        right = nxt[touched]
        fresh = np.where(right < n, vocabulary.pair_ranks(token[touched], token[right]), NONE)
        rank[touched] = fresh
        if (low := fresh < r).any():
            odd[word[touched[low]]] = True
        enter(touched)
    alive = token[:n] >= 0
    ids, counts = token[:n][alive].astype(np.int32), np.bincount(word[alive], minlength=len(words))
    # a word that is a token is that token, even where its merges do not lead there
    whole = np.fromiter((vocabulary.ranks.get(w, -1) if k > 1 else -1 for w, k in zip(words, counts.tolist())), np.int64, len(words))
    redo = np.flatnonzero(odd | (whole >= 0))
    if len(redo):
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in redo:
            parts[i] = np.array(vocabulary.one(words[i]), np.int32)
        ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
    return ids, counts


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces [start, start + length) of ``pool``, end to end."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return pool[shift + np.arange(total)]


class Encoder:
    """Encodes corpora one after the other and remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary, remember: int = REMEMBER):
        self.vocabulary, self.remember = vocabulary, remember
        self.cut = regex.compile(vocabulary.pattern).findall
        self.known: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def corpus(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the new words of all of them are replayed together."""
        if len(self.known) > self.remember:
            self.forget()
        matches: list[str] = []
        sizes = []
        for text in texts:
            found = self.cut(text)
            sizes.append(len(found))
            matches += found
        new = list(dict.fromkeys(w for w in matches if w not in self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            ids, counts = replay([w.encode("utf-8", "surrogatepass") for w in new], self.vocabulary)
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
            self.ids, self.lengths = np.concatenate((self.ids, ids)), np.concatenate((self.lengths, counts))
        place = np.fromiter(map(self.known.__getitem__, matches), np.int64, len(matches))
        flat = gather(self.ids, self.starts[place], self.lengths[place])
        ends = np.concatenate(([0], np.cumsum(self.lengths[place])))[np.cumsum([0, *sizes])]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _corpora(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def bytes_of(ids: np.ndarray, pool: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """The bytes that ids stand for, from the tokens' bytes end to end."""
    ids = ids.astype(np.int64)
    return gather(pool, offset[ids], length[ids]).tobytes()


def encode(
    documents: DataFrame, ranks: dict[bytes, int], pattern: str, text_column: str = "text", out: str = "ids", *,
    decoded: str | None = None, corpus_chars: int = CORPUS_CHARS, remember: int = REMEMBER,
) -> DataFrame:
    """Add each whole text's ids as little-endian unsigned 32-bit integers, without special tokens.

    Each match of ``pattern`` is encoded separately. A task takes its rows in corpora of
    ``corpus_chars`` characters and replays the merges once over the distinct words of a
    corpus; a text longer than that is a corpus of its own. Words are never shuffled,
    because the result of a word depends on nothing else, so no frequent word is hot.
    ``decoded`` names a second column with the bytes that the ids decode to, made in the
    same pass. Null texts count as empty and have no ids. Clashing columns are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(ranks, pattern))  # bounded: under 10 MB
    new = [out] if decoded is None else [out, decoded]
    taken = {n.lower() for n in new}
    kept = [c for c in documents.columns if c.lower() not in taken]
    text, = fresh(documents, "text_to_encode")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = Encoder(vocabulary, remember)
        for batch in batches:
            at = 0
            for corpus in _corpora(((t.as_py() or "") for t in batch.column(len(kept))), corpus_chars):
                ids = encoder.corpus(corpus)
                columns = [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if decoded is not None:
                    parts = (vocabulary.pool, vocabulary.offset, vocabulary.length)
                    columns.append(pa.array([bytes_of(x, *parts) for x in ids], pa.binary()))
                rows = batch.slice(at, len(corpus))
                at += len(corpus)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *columns], [*kept, *new])
            pa.default_memory_pool().release_unused()

    schema = T.StructType([*[documents.schema[c] for c in kept], *[T.StructField(n, T.BinaryType()) for n in new]])
    return documents.select(*kept, F.col(text_column).cast("string").alias(text)).mapInArrow(encoded, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_column: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that each row's ids stand for; null ids give empty bytes. Ids outside the vocabulary are an error."""
    whole = Vocabulary(ranks, "")
    shared = encoded.sparkSession.sparkContext.broadcast((whole.pool, whole.offset, whole.length))

    @F.arrow_udf("binary")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([bytes_of(np.frombuffer(v.as_py() or b"", "<u4"), *shared.value) for v in batch], pa.binary())

    return encoded.withColumn(out, udf(F.col(ids_column)))


def digests(documents: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Add ids, n_tokens, ids_sha256 and decoded_sha256 of the ids and of what they decode to."""
    both = encode(documents, ranks, pattern, decoded="decoded")
    kept = [c for c in documents.columns if c not in ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")]
    return both.select(
        *kept, "ids", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def production_ranks(spark) -> tuple[dict[bytes, int], str]:
    """The rank file of the contract and its pattern."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return read_ranks(lines), public_tokenizers.PATTERN


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf):
    made = digests(table(spark, sf, "documents").select("doc_id", "text"), *production_ranks(spark))
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
