"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames, each with the number of units (code points) up to its end. A cut looks its
frame up by these counts and decompresses that frame only; frames that lie between cuts move to the output as they are.
Digests stream the frames in order, one decompressed at a time, so no step holds more of a long text than its compressed
frames and one frame in the clear.

Forms: psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle, plain is the text itself. Cuts and form come from
the sha256 of a seed and doc_id, so they do not depend on partitions or on a second run.

Defined cases: a null text counts as empty; an empty text, or one that contains a marker, stays plain; a null doc_id counts as
an empty string in the hash; repeated rows each keep their own result; input columns named like a result column are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = 1 << 14   # code points of a frame
LEVEL = 3
BATCH = 1 << 22   # bytes of frames in a batch of results
MARKERS = ("<P>", "<S>", "<M>")
FRAMES = T.ArrayType(T.StructType([T.StructField("upto", T.LongType(), False), T.StructField("data", T.BinaryType(), False)]), False)
FRAMES_ARROW = pa.list_(pa.struct([("upto", pa.int64()), ("data", pa.binary())]))


class Frames:
    """Frames of one text for reading: whole frames by number, or any stretch of units."""

    def __init__(self, upto: list[int], data: list[bytes], decoder):
        self.upto, self.data, self.decoder = upto, data, decoder
        self.held = (-1, "")  # both cuts often share a frame

    def text(self, i: int) -> str:
        if self.held[0] != i:
            self.held = (i, self.decoder.decompress(self.data[i]).decode())
        return self.held[1]

    def start(self, i: int) -> int:
        return self.upto[i - 1] if i else 0

    def copy(self, lo: int, hi: int, out: Writer) -> None:
        """Units lo..hi-1 to the writer; frames that lie inside are not opened."""
        i = bisect_right(self.upto, lo)
        while lo < hi:
            a, b = self.start(i), self.upto[i]
            if lo == a and b <= hi:
                out.frame(b - a, self.data[i])
            else:
                out.text(self.text(i)[lo - a : min(hi, b) - a])
            lo, i = min(hi, b), i + 1

    def find(self, marker: str, at: int) -> int:
        """First place of the marker at or after a unit, frame by frame."""
        carry, i = "", bisect_right(self.upto, at)
        while i < len(self.upto):
            base = max(at, self.start(i))
            text = carry + self.text(i)[base - self.start(i) :]
            k = text.find(marker)
            if k >= 0:
                return base - len(carry) + k
            carry, i = text[-(len(marker) - 1) :], i + 1
        raise ValueError(f"{marker} is missing")


class Writer:
    """Collects frames; pieces of text are joined until a whole frame follows or a frame is full."""

    def __init__(self, coder):
        self.coder, self.upto, self.data, self.parts, self.n = coder, [], [], [], 0

    def text(self, piece: str) -> None:
        self.parts.append(piece)
        self.n += len(piece)
        if self.n >= FRAME:
            self.flush()

    def frame(self, units: int, data: bytes) -> None:
        self.flush()
        self._add(units, data)

    def flush(self) -> None:
        if self.n:
            self._add(self.n, self.coder.compress("".join(self.parts).encode()))
        self.parts, self.n = [], 0

    def _add(self, units: int, data: bytes) -> None:
        self.upto.append(units + (self.upto[-1] if self.upto else 0))
        self.data.append(data)


class Plain:
    """A writer that only hashes what it is given."""

    def __init__(self, decoder):
        self.decoder, self.sum = decoder, hashlib.sha256()

    def text(self, piece: str) -> None:
        self.sum.update(piece.encode())

    def frame(self, units: int, data: bytes) -> None:
        self.sum.update(self.decoder.decompress(data))


def cut(text: str, coder) -> Writer:
    out = Writer(coder)
    for i in range(0, len(text), FRAME):
        out.text(text[i : i + FRAME])
    out.flush()
    return out


def arrange(source: Frames, form: str, prefix: int | None, middle: int | None, out) -> None:
    """Writes the output of a form; plain is the text."""
    n = source.upto[-1] if source.upto else 0
    if form == "plain":
        pieces = [(0, n)]
    else:
        a, b = prefix, prefix + middle
        pieces = ["<P>", (0, a), "<S>", (b, n), "<M>", (a, b)] if form == "psm" else ["<S>", (b, n), "<P>", (0, a), "<M>", (a, b)]
    for piece in pieces:
        if isinstance(piece, str):
            out.text(piece)
        else:
            source.copy(*piece, out)


def rebuild(source: Frames, form: str, out) -> None:
    """Writes the text that an output and its form stand for."""
    n = source.upto[-1] if source.upto else 0
    if form == "plain":
        pieces = [(0, n)]
    else:
        second = source.find("<S>" if form == "psm" else "<P>", 3)
        third = source.find("<M>", second + 3)
        first, last = (3, second), (second + 3, third)
        prefix, suffix = (first, last) if form == "psm" else (last, first)
        pieces = [prefix, (third + 3, n), suffix]
    for piece in pieces:
        source.copy(*piece, out)


def _opened(column: pa.Array, decoder) -> list[Frames]:
    """Frames of every row of a batch."""
    bounds = column.offsets.to_pylist()
    upto, data = column.values.field("upto").to_pylist(), column.values.field("data").to_pylist()
    return [Frames(upto[a:b], data[a:b], decoder) for a, b in zip(bounds, bounds[1:])]


def _closed(rows: list[Writer]) -> pa.Array:
    offsets = [0]
    for w in rows:
        offsets.append(offsets[-1] + len(w.data))
    items = pa.StructArray.from_arrays([pa.array([x for w in rows for x in w.upto], pa.int64()), pa.array([x for w in rows for x in w.data], pa.binary())], ["upto", "data"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items).cast(FRAMES_ARROW)


def _slices(batch, column: str):
    """Slices of a batch with about BATCH bytes of one column."""
    size = max(1, batch.num_rows * BATCH // max(1, batch.column(column).nbytes))
    for lo in range(0, batch.num_rows, size):
        yield batch.slice(lo, size)


def _without(df: DataFrame, *names: str) -> DataFrame:
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, then n (units), marked (contains a marker) and frames."""
    docs = _without(docs, "n", "marked", "frames")
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != text], T.StructField("n", T.LongType(), False), T.StructField("marked", T.BooleanType(), False), T.StructField("frames", FRAMES, False)])

    def run(batches):
        coder = zstandard.ZstdCompressor(level=LEVEL)
        for whole in batches:
            for batch in _slices(whole, text):
                at = batch.schema.get_field_index(text)
                keep = [i for i in range(batch.num_columns) if i != at]
                texts = [x.as_py() or "" for x in batch.column(at)]
                found = [pa.array([len(t) for t in texts], pa.int64()), pa.array([any(m in t for m in MARKERS) for t in texts]), _closed([cut(t, coder) for t in texts])]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *found], schema.names)

    return docs.mapInArrow(run, schema)


def draws(seed: str) -> list[Column]:
    """Four numbers of 32 bits for a document, from the sha256 of the seed, a colon and doc_id."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(code, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(stored: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Stored rows with form, prefix_chars and middle_chars (null if plain) and frames, now those of the output."""
    h1, h2, h3, h4 = draws(seed)
    n = F.col("n") + 1
    form = F.when((F.col("n") == 0) | F.col("marked") | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = _without(stored, "form", "prefix_chars", "middle_chars")
    rows = rows.withColumn("form", form).withColumn("prefix_chars", F.when(F.col("form") != "plain", F.least(h1 % n, h2 % n)))
    rows = rows.withColumn("middle_chars", F.when(F.col("form") != "plain", F.abs(h1 % n - h2 % n)))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "marked"])
    rows = rows.select(*schema.names)

    def run(batches):
        coder, decoder = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in _slices(whole, "frames"):
                form, prefix, middle = (batch.column(c).to_pylist() for c in ("form", "prefix_chars", "middle_chars"))
                out = []
                for i, source in enumerate(_opened(batch.column("frames"), decoder)):
                    out.append(Writer(coder))
                    arrange(source, form[i], prefix[i], middle[i], out[-1])
                    out[-1].flush()
                at = batch.schema.get_field_index("frames")
                yield pa.RecordBatch.from_arrays([_closed(out) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return rows.mapInArrow(run, schema)


def restore(made: DataFrame) -> DataFrame:
    """Transformed rows with frames, now those of the text rebuilt from output and form."""
    schema = made.schema

    def run(batches):
        coder, decoder = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in _slices(whole, "frames"):
                out = []
                for form, source in zip(batch.column("form").to_pylist(), _opened(batch.column("frames"), decoder)):
                    out.append(Writer(coder))
                    rebuild(source, form, out[-1])
                    out[-1].flush()
                at = batch.schema.get_field_index("frames")
                yield pa.RecordBatch.from_arrays([_closed(out) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return made.mapInArrow(run, schema)


def texts(rows: DataFrame, name: str = "text") -> DataFrame:
    """Rows with their frames decompressed into one string column."""
    rows = _without(rows, name) if name.lower() != "frames" else rows
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "frames"], T.StructField(name, T.StringType(), False)])

    def run(batches):
        decoder = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in _slices(whole, "frames"):
                at = batch.schema.get_field_index("frames")
                found = ["".join(f.text(i) for i in range(len(f.data))) for f in _opened(batch.column(at), decoder)]
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(found, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def digests(made: DataFrame) -> DataFrame:
    """Transformed rows without frames, with the sha256 of the output and of the text rebuilt from it, both streamed."""
    rows = _without(made, "output_sha256", "restored_sha256")
    names = ["output_sha256", "restored_sha256"]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "frames"], *[T.StructField(c, T.StringType(), False) for c in names]])

    def run(batches):
        decoder = zstandard.ZstdDecompressor()
        for batch in batches:
            at, sums = batch.schema.get_field_index("frames"), ([], [])
            for form, source in zip(batch.column("form").to_pylist(), _opened(batch.column(at), decoder)):
                output, back = Plain(decoder), Plain(decoder)
                for data in source.data:
                    output.frame(0, data)
                rebuild(source, form, back)
                sums[0].append(output.sum.hexdigest())
                sums[1].append(back.sum.hexdigest())
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], *[pa.array(s, pa.string()) for s in sums]], schema.names)

    return rows.mapInArrow(run, schema)
