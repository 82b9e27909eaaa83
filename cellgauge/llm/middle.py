"""Fill-in-the-middle texts, put together by a secondary sort of pieces and taken apart by another."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.llm.common import fresh, query, table

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
LETTERS = re.compile("[A-Za-z]*")
MARKS = {"P": "<P>", "S": "<S>", "M": "<M>"}
#: Sections as they stand in the output, and their places in the text.
OUTPUT = {"psm": "PSM", "spm": "SPM"}
PLACE = {"P": 0, "M": 1, "S": 2}
LAST = (9, 0)  # sorts after every piece of a document
SEED = 1
FIM_PERCENT = 90
SPM_PERCENT = 20
CHUNK_UNITS = 16_384
SLICE_CHARS = 1 << 20  # characters cut into units at a time
SEEN = 200_000  # documents a task counts repeats of before it forgets them
TASK_BYTES = 64 << 20  # text that one sorting task takes, on average

Piece = tuple[tuple[bytes, tuple[int, int]], object]


def unit_lengths(text: str, slice_chars: int = SLICE_CHARS) -> Iterator[list[int]]:
    """Lengths of the units of a text, in lists for slices that end between units."""
    at = 0
    while at < len(text):
        upto = at + slice_chars
        if upto < len(text):
            upto = LETTERS.match(text, upto).end()
        yield [len(u) for u in UNIT.findall(text, at, upto)]
        at = upto


def unit_offsets(text: str, wanted: Sequence[int], lengths: Sequence[list[int]] | None = None) -> list[int]:
    """Character offsets of the rising unit numbers ``wanted``."""
    offsets, unit, char, todo = [], 0, 0, list(wanted)[::-1]
    for part in unit_lengths(text) if lengths is None else lengths:
        ends = list(accumulate(part, initial=char))
        while todo and todo[-1] <= unit + len(part):
            offsets.append(ends[todo.pop() - unit])
        unit, char = unit + len(part), ends[-1]
    return offsets + [char] * len(todo)


def decide(doc_id: object, text: str, n: int, seed: int, fim_percent: int, spm_percent: int) -> tuple[str, int, int]:
    """Form, and the units after which prefix and middle end. Seed and id decide alone; a null id counts as ''."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or h3 % 100 >= fim_percent or any(mark in text for mark in MARKS.values()):
        return "plain", n, n
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < spm_percent else "psm", first, second


def cut(doc_id: object, text: str, seed: int, fim_percent: int, spm_percent: int, chunk_units: int) -> tuple[tuple, list[bytes]]:
    """What is known of a document (form, n, prefix_chars, middle_chars) and its pieces in output order.

    A piece holds up to ``chunk_units`` units of one section; a section's first piece begins with its mark.
    """
    short = list(unit_lengths(text)) if len(text) <= SLICE_CHARS else None  # long texts are cut twice rather than held
    n = sum(map(len, unit_lengths(text) if short is None else short))
    form, first, second = decide(doc_id, text, n, seed, fim_percent, spm_percent)
    spans = {"P": (0, first), "M": (first, second), "S": (second, n)} if form != "plain" else {"": (0, n)}
    cuts = sorted({n, *(u for low, high in spans.values() for u in (*range(low, high, chunk_units), low, high))})
    char = dict(zip(cuts, unit_offsets(text, cuts, short)))
    pieces = []
    for section in OUTPUT.get(form, [""]):
        low, high = spans[section]
        edges = [*range(low, high, chunk_units), high]
        parts = [text[char[a] : char[b]] for a, b in zip(edges, edges[1:])] or [""]
        parts[0] = MARKS.get(section, "") + parts[0]
        pieces += [part.encode("utf-8", "surrogatepass") for part in parts]
    chars = (None, None) if form == "plain" else (char[first], char[second] - char[first])
    return (form, n, *chars), pieces


def emit(rows: Iterator[tuple], settings: tuple) -> Iterator[Piece]:
    """Pieces keyed by document and output position, after a head with the row and how often it came.

    The document is a digest of the whole row, so rows equal in everything share their
    pieces: a task sends them once and counts the repeats.
    """
    times: dict[bytes, list] = {}

    def heads() -> Iterator[Piece]:
        for document, head in times.items():
            yield (document, (0, 0)), tuple(head)
        times.clear()

    for *kept, doc_id, text in rows:
        text = text or ""
        digest = hashlib.blake2b(repr((kept, doc_id)).encode("utf-8", "surrogatepass"), digest_size=16)
        digest.update(b"\0" + text.encode("utf-8", "surrogatepass"))
        document = digest.digest()
        if document in times:
            times[document][0] += 1
            continue
        known, pieces = cut(doc_id, text, *settings)
        times[document] = [1, tuple(kept), known]
        for position, piece in enumerate(pieces):
            yield (document, (1, position)), piece
        if len(times) >= SEEN:
            yield from heads()
    yield from heads()


def restore(form: str) -> Iterator[list[tuple[tuple[int, int], bytes]]]:
    """Send it the output piece by piece, then None: it answers with what can be placed in the original.

    Only the output and its form are read. A mark may lie across two pieces, so up to two
    bytes wait for the next. No text holds a mark and no mark begins as one ends, so the
    first one found is the template's.
    """
    marks = [MARKS[s].encode() for s in OUTPUT.get(form, "")]
    places = [0] if not marks else [PLACE[s] for s in OUTPUT[form]]
    section, waiting, sequence, ready = (-1 if marks else 0), b"", 0, []
    while True:
        piece = yield ready
        ready = []
        data = waiting + (piece or b"")
        waiting = b""
        while section + 1 < len(marks) and (at := data.find(marks[section + 1])) >= 0:
            if section >= 0:
                ready.append(((places[section], sequence), data[:at]))
                sequence += 1
            data = data[at + len(marks[section + 1]) :]
            section += 1
        if piece is not None and section + 1 < len(marks):
            data, waiting = data[:-2], data[-2:]
        if data:
            ready.append(((places[max(section, 0)], sequence), data))
            sequence += 1


def replay(pieces: Iterator[Piece], with_text: bool) -> Iterator[Piece]:
    """Digest every output as its pieces pass, and send the pieces on, keyed by their place in the original."""

    def end() -> Iterator[Piece]:
        for place, part in back.send(None):
            yield (document, place), part
        whole = (b"".join(output).decode("utf-8", "surrogatepass"),) if with_text else ()
        yield (document, LAST), (times, kept, known, digest.hexdigest(), *whole)

    document, last = None, None
    for (owner, position), value in pieces:
        if owner != document:
            if document is not None:
                yield from end()
            document, last, times, output = owner, None, 0, []
            digest, back = hashlib.sha256(), None
        if position == (0, 0):
            n, kept, known = value
            times += n
            continue
        if position == last:  # the same piece, from another task
            continue
        if back is None:
            back = restore(known[0])
            next(back)
        last = position
        digest.update(value)
        if with_text:
            output.append(value)
        for place, part in back.send(value):
            yield (document, place), part
    if document is not None:
        yield from end()


def finish(pieces: Iterator[Piece]) -> Iterator[tuple]:
    """One row for each input row: what is known, and the digests of the output and of the restored text."""
    digest = hashlib.sha256()
    for (_, place), value in pieces:
        if place != LAST:
            digest.update(value)
            continue
        times, kept, known, output, *whole = value
        for _ in range(times):
            yield (*kept, known[1], known[0], known[2], known[3], output, digest.hexdigest(), *whole)
        digest = hashlib.sha256()


def bucket(key: tuple) -> int:
    """Where a document's pieces go."""
    return int.from_bytes(key[0][:7], "big")


def fill_in_middle(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, keep: Sequence[str] | None = None,
    seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, chunk_units: int = CHUNK_UNITS,
    with_text: bool = False, partitions: int | None = None,
) -> DataFrame:
    """Rearrange each text as prefix, suffix, middle, and prove that it can be put back.

    Units are runs of ASCII letters and other single code points. The seed and the id
    decide where prefix and middle end and which form is taken: ``plain`` (the text as it
    is), ``psm`` or ``spm``. Adds n (units), form, prefix_chars, middle_chars (code points,
    null if plain), output_sha256, restored_sha256 (of the text rebuilt from the output and
    its form) and, if asked, fim_text, to the columns ``keep`` (default: all but the text). Null texts are
    empty, empty texts and those holding a mark are plain, a null id counts as ''. Rows
    equal in all these columns are treated once and returned as often as they came. An
    empty table gives an empty table. Clashing columns are replaced.

    Pieces of ``chunk_units`` units are shuffled once, by document, and sorted by output
    position; each task streams them into digests, so no text is ever whole in the sorting
    half. The second sort, by original position, has the same partitioner and stays where
    the pieces are. Both sorts spill. A lost task repeats the same pieces. The number of
    tasks follows the bytes of text, which are counted first, unless ``partitions`` is given.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "fim_text"]
    kept = [c for c in documents.columns if c != text_column] if keep is None else list(keep)
    kept = [c for c in kept if c.lower() not in new]
    spark = documents.sparkSession
    doc_id, text = fresh(documents, "fim_id", "fim_source")
    rows = documents.select(*kept, F.col(id_column).alias(doc_id), F.col(text_column).cast("string").alias(text))
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    settings = (seed, fim_percent, spm_percent, chunk_units)
    order = lambda key: key
    pieces = rows.rdd.mapPartitions(lambda part: emit(part, settings))
    outputs = pieces.repartitionAndSortWithinPartitions(partitions, bucket, True, order)
    placed = outputs.mapPartitions(lambda part: replay(part, with_text), preservesPartitioning=True)
    restored = placed.repartitionAndSortWithinPartitions(partitions, bucket, True, order)
    types = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), *[T.StringType()] * 3]
    fields = [T.StructField(c, t) for c, t in zip(new, types)][: len(new) if with_text else -1]
    schema = T.StructType([*[documents.schema[c] for c in kept], *fields])
    return spark.createDataFrame(restored.mapPartitions(finish), schema, verifySchema=False)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
k AS (SELECT *, len(u)::BIGINT AS n, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS x FROM d),
e AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 90 THEN 'plain'
    WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
s AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM s
"""


@query("op12_fill_in_middle", SQL)
def op12_fill_in_middle(spark, sf):
    made = fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"])
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
