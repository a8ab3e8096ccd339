"""Fill-in-middle transformation by displacement scatter.

A text is cut into lines; two hashes of its id choose where its prefix and its middle end.  A batch of texts is
one run of bytes.  Its line ends are scanned for the cuts; each prefix, middle and suffix then moves by one
shift, and the changes of shift stand at the cuts as a difference array.  The cumulative sum gives every byte its
displacement, and one numpy scatter writes all outputs of the batch; the sentinels go into the gaps.  Restoring
finds the sentinels in the output alone and gathers the bytes back with the inverse displacements.

All scans, sums and scatters go over blocks of ``BLOCK`` bytes that carry the running shift, and a batch is
worked on in slices of about ``SLICE`` bytes, so memory is a text, its output and a few blocks, however long the text is.
Each row is decided on its own: nothing is shuffled.

Results of the edge cases: null counts as the empty text, which is ``plain`` and stays empty; a text
that holds a sentinel is ``plain``; a null id hashes as an empty number; repeated rows give repeated results; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20
SLICE = 1 << 23
SENTINELS = (b"<P>", b"<S>", b"<M>")
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}  # prefix 0, middle 1, suffix 2, in the order of the output
MARK = (0, 2, 1)  # sentinel of prefix, middle and suffix


def check_sentinels(sentinels: tuple[bytes, ...]) -> None:
    """Sentinels must be found again next to any text: none holds or overlaps another or itself."""
    for (i, a), (j, b) in product(enumerate(sentinels), repeat=2):
        if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
            raise ValueError(f"sentinels {a!r} and {b!r} cannot be told apart")


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a binary column without copying its bytes; null is empty."""
    column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs - offs[0], data[offs[0]:offs[-1]]


def binary_column(offs: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(data)]).cast(pa.binary())


def blocks(n: int) -> Iterator[tuple[int, int]]:
    return ((b, min(b + BLOCK, n)) for b in range(0, n, BLOCK))


def line_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line ends before each offset, units of each text): a unit ends after a line end or with the text."""
    before, seen = np.zeros(len(offs), np.int64), 0
    for b, e in blocks(len(data)):
        ends = np.flatnonzero(data[b:e] == 10) + b
        lo, hi = np.searchsorted(offs, [b, e], "right")
        before[lo:hi] = seen + np.searchsorted(ends, offs[lo:hi])
        seen += len(ends)
    before[np.searchsorted(offs, len(data)):] = seen
    full = offs[1:] > offs[:-1]
    open_end = np.zeros(len(full), bool)
    open_end[full] = data[offs[1:][full] - 1] != 10
    return before, np.diff(before) + open_end


def cut_positions(data: np.ndarray, offs: np.ndarray, before: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Byte position after ``units[k]`` units of text k, for each row of ``units`` (texts x cuts, ascending in a row)."""
    inner = before[1:] - before[:-1]
    out = np.where(units == 0, offs[:-1, None], offs[1:, None])
    at_end = (units > 0) & (units <= inner[:, None])  # a cut after a line end
    wanted = (before[:-1, None] + units - 1)[at_end]
    found, seen = np.zeros(len(wanted), np.int64), 0
    for b, e in blocks(len(data)):
        ends = np.flatnonzero(data[b:e] == 10)
        lo, hi = np.searchsorted(wanted, [seen, seen + len(ends)])
        found[lo:hi] = ends[wanted[lo:hi] - seen] + b + 1
        seen += len(ends)
    out[at_end] = found
    return out


def find(data: np.ndarray, offs: np.ndarray, word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(text, byte position) of every place where ``word`` lies within one text."""
    texts, places = [], []
    for b, e in blocks(len(data)):
        at = np.flatnonzero(data[b:e] == word[0]) + b
        text = np.searchsorted(offs, at, "right") - 1
        inside = at + len(word) <= offs[text + 1]
        at, text = at[inside], text[inside]
        for j in range(1, len(word)):
            same = data[at + j] == word[j]
            at, text = at[same], text[same]
        texts.append(text)
        places.append(at)
    return (np.concatenate(texts), np.concatenate(places)) if texts else (np.zeros(0, np.int64),) * 2


def displacements(n: int, at: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, shift of every byte) by blocks: from ``at[k]`` (ascending) on bytes move by ``shift[k]``."""
    step, carry = np.diff(shift, prepend=0), 0
    for b, e in blocks(n):
        lo, hi = np.searchsorted(at, [b, e])
        change = np.zeros(e - b, np.int64)
        np.add.at(change, at[lo:hi] - b, step[lo:hi])
        change[0] += carry
        moved = np.cumsum(change)
        carry = moved[-1]
        yield b, e, moved


def layout(lengths: np.ndarray, forms: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose three parts have ``lengths`` (texts x 3): offsets of the outputs, the place of each part
    (texts x 3) and of its sentinel in the joined outputs.  ``marks`` are the sentinels' lengths by part."""
    plain = forms == "plain"
    size = lengths.sum(1) + np.where(plain, 0, marks.sum())
    offs = np.concatenate([[0], np.cumsum(size)])
    place = offs[:-1, None] + np.cumsum(lengths, 1) - lengths
    for form, order in ORDERS.items():
        rows, pos = forms == form, None
        for part in order:
            pos = (offs[:-1] if pos is None else pos) + marks[part]
            place[rows, part] = pos[rows]
            pos = pos + lengths[:, part]
    return offs, place, place - np.where(plain[:, None], 0, marks)


def scatter(data: np.ndarray, offs: np.ndarray, cuts: np.ndarray, forms: np.ndarray, sentinels: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the outputs of texts cut at ``cuts`` (texts x 2)."""
    starts = np.column_stack([offs[:-1], cuts])
    lengths = np.diff(np.column_stack([starts, offs[1:]]), axis=1)
    marks = np.array([len(sentinels[MARK[p]]) for p in range(3)])
    out_offs, place, mark_at = layout(lengths, forms, marks)
    out = np.zeros(out_offs[-1], np.uint8)
    for b, e, moved in displacements(len(data), starts.ravel(), (place - starts).ravel()):
        out[moved + np.arange(b, e)] = data[b:e]
    cut = forms != "plain"
    for part in range(3):
        for j, byte in enumerate(sentinels[MARK[part]]):
            out[mark_at[cut, part] + j] = byte
    return out_offs, out


def gather(data: np.ndarray, offs: np.ndarray, forms: np.ndarray, sentinels: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the texts that ``scatter`` moved.  ValueError for an output that does not hold each sentinel
    once in the order of its form."""
    n, marks = len(forms), np.array([len(sentinels[MARK[p]]) for p in range(3)])
    mark_at = np.repeat(offs[:-1, None], 3, 1)
    cut = forms != "plain"
    for part in range(3):
        text, at = find(data, offs, sentinels[MARK[part]])
        text, at = text[cut[text]], at[cut[text]]
        if not np.array_equal(text, np.flatnonzero(cut)):
            raise ValueError("an output does not hold each sentinel once")
        mark_at[text, part] = at
    lengths = np.zeros((n, 3), np.int64)
    lengths[:, 0] = np.where(cut, 0, np.diff(offs))
    for form, order in ORDERS.items():
        rows = forms == form
        stops = np.column_stack([mark_at[:, order], offs[1:]])[rows]
        if (np.diff(stops, axis=1) < marks[list(order)]).any() or (stops[:, 0] != offs[:-1][rows]).any():
            raise ValueError(f"the sentinels of an output are not in the order of {form}")
        lengths[np.ix_(rows, order)] = np.diff(stops, axis=1) - marks[list(order)]
    starts = np.where(cut[:, None], mark_at + marks, offs[:-1, None])
    text_offs = np.concatenate([[0], np.cumsum(lengths.sum(1))])
    home = text_offs[:-1, None] + np.cumsum(lengths, 1) - lengths
    out = np.zeros(text_offs[-1], np.uint8)
    for b, e, moved in displacements(len(out), home.ravel(), (starts - home).ravel()):
        out[b:e] = data[moved + np.arange(b, e)]
    return text_offs, out


def slices(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLICE`` bytes; a longer text is a run of its own."""
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE, "right")) - 1)
        yield lo, hi
        lo = hi


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50,
              sentinels: tuple[bytes, ...] = SENTINELS) -> DataFrame:
    """Per document: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    ``rate`` percent of the texts are moved, ``spm_rate`` percent of these with the suffix first.  The choices come from
    the SHA-256 of ``seed:id``, so any run on any cluster makes the same ones.
    """
    check_sentinels(sentinels)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_offs, all_data = column_bytes(batch.column(1))
            draws = np.array([[int(h[8 * k:8 * k + 8], 16) for k in range(4)] for h in batch.column(2).to_pylist()], np.int64).reshape(-1, 4)
            for lo, hi in slices(all_offs):
                offs, data, h = all_offs[lo:hi + 1] - all_offs[lo], all_data[all_offs[lo]:all_offs[hi]], draws[lo:hi]
                before, n = line_counts(data, offs)
                cuts = cut_positions(data, offs, before, np.sort(h[:, :2] % (n + 1)[:, None], axis=1))
                plain = (n == 0) | (h[:, 2] % 100 >= rate)
                for word in sentinels:
                    plain[find(data, offs, word)[0]] = True
                forms = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm_rate, "spm", "psm"))
                out_offs, out = scatter(data, offs, cuts, forms, sentinels)
                first = (data & 0xC0) != 0x80  # one byte of each code point
                chars = np.array([[np.count_nonzero(first[s:p]), np.count_nonzero(first[p:m])]
                                  for s, (p, m) in zip(offs[:-1], cuts)], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(forms.tolist(), pa.string()),
                     pa.array(chars[:, 0], pa.int64(), mask=plain), pa.array(chars[:, 1], pa.int64(), mask=plain), binary_column(out_offs, out)],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), hashed.alias("draws"))
    out = rows.mapInArrow(run, f"id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return out.withColumnRenamed("id", id_col).withColumn("output", F.col("output").cast("string"))


def restore(moved: DataFrame, sentinels: tuple[bytes, ...] = SENTINELS) -> DataFrame:
    """``moved`` (form, output and any other columns) with ``restored``: the text, from output and form alone."""
    check_sentinels(sentinels)
    rest = [c for c in moved.columns if c not in ("output", "restored")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_offs, all_data = column_bytes(batch.column(len(rest)))
            forms = np.array(batch.column(rest.index("form")).to_pylist(), dtype=object)
            for lo, hi in slices(all_offs):
                offs, data = all_offs[lo:hi + 1] - all_offs[lo], all_data[all_offs[lo]:all_offs[hi]]
                text = binary_column(*gather(data, offs, forms[lo:hi], sentinels))
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns] + [text], names=[*rest, "output", "restored"])

    schema = moved.select(*rest).schema.add("output", "binary").add("restored", "binary")
    out = moved.select(*rest, F.col("output").cast("binary")).mapInArrow(run, schema)
    return out.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})
